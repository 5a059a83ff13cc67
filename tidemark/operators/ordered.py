"""Ordered work on series of any length.

A series is the set of rows of one key in a total order.  A single key may hold
a large share of all rows, so nothing here gives a whole series to one task
unless its size was counted first:

* ``running`` builds exclusive prefix sums in two levels: range partitions give
  partial totals, a window over the few partial totals gives offsets, and each
  partition adds its own rows.
* ``Series`` holds rows with a dense position per key (the same two levels).
* ``with_halo`` splits a series into chunks of fixed length and copies the rows
  before (after) each chunk that a bounded frame needs.  Windows and Arrow
  kernels then run per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session


def largest_key(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(number of keys, rows of the largest key), from one partial aggregate."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(
        F.count(F.lit(1)).alias("n"))
    row = counted.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("m")).first()
    return int(row["k"] or 0), int(row["m"] or 0)


def range_placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by key and order, on stable storage.

    ``_part`` is the partition number and ``_slot`` the position inside it.  The
    rows are checkpointed because two later jobs must see the same boundaries.
    """
    spark = df.sparkSession
    columns = [F.col(c) for c in [*keys, *order]]
    placed = (
        df.repartitionByRange(session.parallelism(spark), *columns)
        .sortWithinPartitions(*columns)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
        .withColumn("_slot", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )
    return session.cut(placed)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
    split: bool | None = None,
    following: dict[str, str] | None = None,
) -> DataFrame:
    """Add sums over all earlier rows of the key (the row itself excluded).

    ``sums`` maps the new column to the summed expression.  ``totals`` maps a new
    column to the name of a sum whose key total is wanted on each row.  ``following``
    maps a new column to one without nulls whose value in the next row is wanted.
    """
    totals, following = totals or {}, following or {}
    spark = df.sparkSession
    valued = df.select("*", *[e.alias(f"_v_{n}") for n, e in sums.items()])
    if split is None:
        split = largest_key(df, keys)[1] > session.group_rows(spark)
    drop = [f"_v_{n}" for n in sums]
    if not split:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys)
        out = valued.select(
            "*",
            *[F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)).alias(n) for n in sums],
            *[F.sum(f"_v_{s}").over(whole).alias(t) for t, s in totals.items()],
            *[F.lead(c).over(Window.partitionBy(*keys).orderBy(*order)).alias(n) for n, c in following.items()],
        )
        return out.drop(*drop)
    placed = range_placed(valued, keys, order)
    parts = placed.groupBy(*keys, "_part").agg(
        *[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums],
        *[F.min_by(c, "_slot").alias(f"_f_{n}") for n, c in following.items()])
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = parts.select(
        *keys, "_part",
        *[F.coalesce(F.sum(f"_p_{n}").over(w), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_p_{s}").over(whole).alias(t) for t, s in totals.items()],
        *[F.lead(f"_f_{n}").over(Window.partitionBy(*keys).orderBy("_part")).alias(f"_b_{n}") for n in following],
    )
    local = Window.partitionBy("_part", *keys).orderBy("_slot").rowsBetween(
        Window.unboundedPreceding, -1)
    out = placed.select("*", *[
        F.coalesce(F.sum(f"_v_{n}").over(local), F.lit(0)).alias(f"_l_{n}") for n in sums],
        *[F.lead(c).over(Window.partitionBy("_part", *keys).orderBy("_slot")).alias(f"_a_{n}") for n, c in following.items()])
    out = out.join(offsets, [*keys, "_part"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.col(f"_l_{n}"))
    for n in following:
        out = out.withColumn(n, F.coalesce(f"_a_{n}", f"_b_{n}"))
    return out.drop(*drop, "_part", "_slot", *[f"_o_{n}" for n in sums], *[f"_l_{n}" for n in sums],
                    *[f"_{x}_{n}" for n in following for x in "ab"])


@dataclass(frozen=True)
class Series:
    """Rows with a dense position ``idx`` inside each key."""

    df: DataFrame
    keys: list[str]
    idx: str
    count: int
    longest: int

    @property
    def spark(self):
        return self.df.sparkSession

    def using(self, df: DataFrame) -> Series:
        return replace(self, df=df)


def series(df: DataFrame, keys: list[str], order: list[str], idx: str = "idx") -> Series:
    """Give every row its zero-based position in the total order of its key."""
    spark = df.sparkSession
    count, longest = largest_key(df, keys)
    if longest <= session.group_rows(spark):
        w = Window.partitionBy(*keys).orderBy(*order)
        return Series(df.withColumn(idx, F.row_number().over(w).cast("long") - 1),
                      keys, idx, count, longest)
    placed = range_placed(df, keys, order)
    heads = placed.groupBy(*keys, "_part").agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.select(
        *keys, "_part",
        (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_base"))
    out = (
        placed.join(offsets, [*keys, "_part"])
        .withColumn(idx, F.col("_base") + F.col("_slot"))
        .drop("_part", "_slot", "_base")
    )
    return Series(out, keys, idx, count, longest)


def with_halo(s: Series, before: int = 0, after: int = 0, rows: int | None = None) -> DataFrame:
    """Rows with ``_chunk`` and ``_own``; border rows appear in several chunks."""
    size = rows or session.chunk_rows(s.spark)
    idx = F.col(s.idx)
    home = F.floor(idx / size).cast("long")
    if before == 0 and after == 0:
        return s.df.withColumn("_chunk", home).withColumn("_own", F.lit(True))
    first = F.greatest(F.floor((idx - after) / size).cast("long"), F.lit(0))
    last = F.floor((idx + before) / size).cast("long")
    return (
        s.df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def framed(
    s: Series,
    build: Callable[[object], dict[str, Column]],
    before: int,
    after: int = 0,
) -> DataFrame:
    """Window columns over a bounded frame, computed chunk by chunk.

    ``build`` gets a window specification (keys and chunk, ordered by position)
    and returns the new columns.  ``before``/``after`` is the reach of the frame.
    """
    chunked = with_halo(s, before, after)
    w = Window.partitionBy(*s.keys, "_chunk").orderBy(s.idx)
    cols = build(w)
    out = chunked.select("*", *[c.alias(n) for n, c in cols.items()])
    return out.where("_own").drop("_own", "_chunk")


def map_chunks(
    s: Series,
    columns: list[str],
    kernel: Callable[[pd.DataFrame, bool, bool], pd.DataFrame],
    schema: str,
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Run an Arrow kernel on each chunk (sorted, halo included) and keep own rows.

    The kernel gets the rows and two flags: whether the first and the last row
    shown to it are the ends of the series.  It returns one row per input row;
    ``schema`` lists the columns it adds to the keys, position and ``columns``.
    """
    idx, keys = s.idx, list(s.keys)
    keep = [*keys, idx, *columns]
    source = s.df.select(*keep)
    if after:
        # the kernel must know where the series ends
        ends = source.groupBy(*keys).agg((F.max(idx)).alias("_end"))
        source = source.join(ends, keys)
    else:
        source = source.withColumn("_end", F.lit(-1).cast("long"))
    chunked = with_halo(s.using(source), before, after)
    fields = {f.name: f.dataType.simpleString() for f in s.df.schema.fields}
    out_schema = ", ".join([f"`{c}` {fields[c]}" for c in keep]) + ", " + schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx, kind="stable").reset_index(drop=True)
        starts = bool(pdf[idx].iloc[0] == 0)
        stops = bool(pdf[idx].iloc[-1] == pdf["_end"].iloc[0])
        out = kernel(pdf, starts, stops)
        return out[pdf["_own"].to_numpy()].drop(columns=["_own", "_chunk", "_end"])

    return chunked.groupBy(*keys, "_chunk").applyInPandas(run, out_schema)


def lag_value(s: Series, value: str, offset: int, name: str) -> DataFrame:
    """The value ``offset`` rows before (negative: after) in the same series."""
    reach = abs(offset)
    before, after = (reach, 0) if offset > 0 else (0, reach)
    return framed(s, lambda w: {name: F.lag(value, offset).over(w)}, before, after)


def columns_of(df: DataFrame, names: Iterable[str]) -> list[Column]:
    return [F.col(n) for n in names]
