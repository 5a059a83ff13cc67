import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import STATE_STORE, build_session

    session = build_session(
        "tests", "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("ckpt")),
        spark__sql__streaming__stateStore__providerClass=STATE_STORE,
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(spark):
    """Force the split paths: short chunks and a low bound on rows per key."""
    spark.conf.set("spark.tidemark.chunkRows", "300")
    spark.conf.set("spark.tidemark.groupRows", "200")
    yield spark
    spark.conf.unset("spark.tidemark.chunkRows")
    spark.conf.unset("spark.tidemark.groupRows")


@pytest.fixture(scope="session")
def sf():
    return str(DATA)
