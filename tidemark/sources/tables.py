"""Readers, writers and quality checks for the engine's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import Series, series
from tidemark.operators.sampling import hash_cap
from tidemark.schema import TRAJECTORY_ERRORS, finite


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or any match of a pattern) is there, on any file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(where)
    return found is not None and len(found) > 0


def read_errors(spark: SparkSession, base: str) -> DataFrame:
    """The error table: parquet if it can be read, else the CSV next to it."""
    try:
        return spark.read.parquet(f"{base}.parquet")
    except AnalysisException:
        return spark.read.csv(f"{base}.csv", header=True, schema=TRAJECTORY_ERRORS)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A parquet scan that reads only the named columns."""
    return spark.read.parquet(path).select(*columns)


def read_csv_numeric(
    spark: SparkSession, path: str, schema: T.StructType, numeric: dict[str, str]
) -> DataFrame:
    """CSV with a given schema; values that are no numbers become NULL."""
    df = spark.read.csv(path, header=True, schema=schema)
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in numeric.items()})


def first_lookup(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """First row of each key by an explicit order, instead of file order."""
    first = F.min_by(F.struct(*values), F.struct(*order)).alias("_f")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_f.{v}").alias(v) for v in values])


def read_many(
    spark: SparkSession, patterns: list[str], defaults: dict[str, object], fmt: str = "parquet"
) -> DataFrame:
    """All matching files stacked; a column some files lack gets its default."""
    present = [p for p in patterns if exists(spark, p)]
    if not present:
        raise FileNotFoundError(f"none of {patterns} is there")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    frames = [reader.load(p) for p in present]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    for name, value in defaults.items():
        current = F.col(name) if name in out.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(current, F.lit(value)))
    return out


def load_inputs(
    spark: SparkSession, paths: dict[str, str], source_column: str, row_id: str,
    cap: int | None = None, seed: int = 42,
) -> DataFrame:
    """Stack the inputs that exist, at most ``cap`` hashed rows of each."""
    present = {n: p for n, p in paths.items() if exists(spark, p)}
    if not present:
        raise FileNotFoundError("no input is there")
    frames = [spark.read.parquet(p).withColumn(source_column, F.lit(n)) for n, p in present.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out if cap is None else hash_cap(out, [source_column], row_id, cap, seed)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def cached_features(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read a feature table, building and writing it on first use."""
    if not exists(spark, f"{path}/_SUCCESS"):
        write_table(build(), path)
    return spark.read.parquet(path)


def write_tracks(df: DataFrame, path: str, keys: list[str], order: list[str], values: list[str]) -> None:
    """Track rows as a table sorted by key and order inside each file.

    Rows stay rows: a track of any length is spread over row groups instead of
    being packed into one array.
    """
    out = df.select(*keys, *order, *[v for v in values if v not in order])
    out.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).write.mode(
        "overwrite").parquet(path)


def pack_tracks(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row per track with arrays in order, for tracks short by nature."""
    packed = F.array_sort(F.collect_list(F.struct(*order, *[v for v in values if v not in order])))
    return df.groupBy(*keys).agg(packed.alias("_t")).select(
        *keys, *[F.col(f"_t.{v}").alias(v) for v in values])


def quality_report(
    df: DataFrame, group: list[str], columns: list[str], extra: dict[str, Column] | None = None
) -> DataFrame:
    """Rows and unusable values per group, with further soft checks."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~finite(c) | F.col(c).isNull()).alias(f"bad_{c}") for c in columns],
        *[e.alias(n) for n, e in (extra or {}).items()])


def expected_inputs(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys with a flag that says whether any row is there."""
    seen = present.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return expected.join(seen, keys, "left").select(
        *expected.columns, F.coalesce("_seen", F.lit(False)).alias("present"))


def error_stream(
    df: DataFrame, keys: list[str], horizon: str | None = None,
    order: list[str] | None = None,
) -> Series:
    """The error table as ordered series with a dense position."""
    if horizon is not None:
        df = df.where(F.col("horizon") == horizon)
    return series(df, keys, order or ["year", "match_id", "traj_id"])
