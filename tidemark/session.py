"""Session settings and the two size bounds the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHUNK_ROWS = "spark.tidemark.chunkRows"
GROUP_ROWS = "spark.tidemark.groupRows"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC time, Arrow, AQE and the RocksDB state store."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Kernels are sent by name, so every worker must be able to import them, from
    whatever folder the job was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-ship-")) / "tidemark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def chunk_rows(spark: SparkSession) -> int:
    """Rows of one series that a single task works on."""
    return int(spark.conf.get(CHUNK_ROWS, "200000"))


def group_rows(spark: SparkSession) -> int:
    """Largest key that a plain window or a per-key map may hold in one task."""
    return int(spark.conf.get(GROUP_ROWS, "1000000"))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class NoSharedFolder(RuntimeError):
    """A cluster without a folder that all its machines see."""


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a local one only on a local master, as in tests."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.split("[")[0] == "local":
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
    target = configured or tempfile.mkdtemp(prefix="tidemark-ckpt-")
    context.setCheckpointDir(target)
    return target


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and read on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the checkpoint folder for a table written by a job."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
