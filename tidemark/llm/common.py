"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_path

#: A word is a run of characters other than ASCII white space (a fixed value).
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back: later jobs start there
    and a lost executor costs no more than its own tasks."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fits(side: DataFrame) -> bool:
    """True when a count of rows, text bytes and list items proves that a side table may be broadcast."""
    kinds = {f.name: f.dataType.typeName() for f in side.schema.fields}
    parts = [F.octet_length(c) for c, k in kinds.items() if k in ("string", "binary")]
    parts += [32 * F.greatest(F.size(c), F.lit(0)) for c, k in kinds.items() if k == "array"]
    width = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(8 * len(kinds)))
    n, size = side.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def attach(df: DataFrame, side: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """Join a stored side table, by broadcast where its counted size allows it."""
    return df.join(F.broadcast(side) if fits(side) else side, on, how)


def unit(*cols: Column | str) -> Column:
    """A draw in [0, 1) that depends on the given columns only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def words(text: Column | str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def attach_salted(df: DataFrame, side: DataFrame, on: list[str], spread: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join a stored side table with one row a key, by broadcast where its counted size allows it; else by
    a shuffle in which the rows of one key go to several tasks, chosen by ``spread``, and the side to all of these."""
    if fits(side):
        return df.join(F.broadcast(side), on, how)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(spread, F.lit("salt")), F.lit(salts)).cast("int"))
    right = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def numbered(counted: DataFrame, piece: int = 1024) -> DataFrame:
    """One row per counted row: a table with ``n`` becomes n rows each, numbered by ``ordinal`` from 0.

    Equal rows are told apart by their number alone, so the result does not depend on the order of
    rows. Groups above ``piece`` rows are dealt to all tasks in pieces.
    """
    names = counted.columns
    small = counted.where(F.col("n") <= piece).withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    cut = counted.where(F.col("n") > piece).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {piece}"))))
    first = F.col("_piece") * piece
    large = cut.repartition(*names, "_piece").withColumn("ordinal", F.explode(F.sequence(first, F.least(first + piece, "n") - 1)))
    return small.unionByName(large.drop("_piece"))
