"""Exact order statistics per key, for keys of any size.

Small keys use the built-in ``percentile``.  It keeps a map of all distinct
values of a key in one task, so keys above the group bound take the long way:
equal values are counted first, the counts are accumulated in two levels, and
the values at the wanted ranks are picked out.  Both give linear interpolation
between the two neighbouring ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators.ordered import largest_key, running


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with their count; equal values merge before the shuffle."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def cumulative(df: DataFrame, keys: list[str], value: str, split: bool | None = None) -> DataFrame:
    """Distinct values with ``cnt``, ``below`` (rows strictly smaller) and ``n``."""
    return accumulated(value_counts(df, keys, value), keys, value, split)


def accumulated(counts: DataFrame, keys: list[str], value: str, split: bool | None = None) -> DataFrame:
    """``cumulative`` of counted values, with the next larger value of the key beside each (``above``)."""
    return running(counts, keys, [value], {"below": F.col("cnt")}, {"n": "below"}, split, {"above": value})


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    name: str = "q",
    split: bool | None = None,
) -> DataFrame:
    """One row per key with ``n`` and the array of quantiles, in order of ``probs``."""
    spark = df.sparkSession
    if split is None:
        split = largest_key(df, keys)[1] > session.group_rows(spark)
    grouped_probs = F.array(*[F.lit(float(p)) for p in probs])
    if not split:
        return df.groupBy(*keys).agg(
            F.count(value).alias("n"), F.percentile(value, grouped_probs).alias(name))
    cum = cumulative(df.where(F.col(value).isNotNull()), keys, value, True)
    # rank of slot i is p_i * (n - 1); a row covers the ranks [below, below + cnt)
    position = lambda p: p * (F.col("n") - 1)
    inside = lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("cnt"))
    slots = F.array(*[
        F.struct(
            F.lit(i).alias("slot"),
            (F.when(inside(F.floor(position(F.lit(float(p))))),
                    1 - (position(F.lit(float(p))) - F.floor(position(F.lit(float(p))))))
             .otherwise(0.0)
             + F.when(inside(F.floor(position(F.lit(float(p)))) + 1),
                      position(F.lit(float(p))) - F.floor(position(F.lit(float(p)))))
             .otherwise(0.0)).alias("w"))
        for i, p in enumerate(probs)])
    hits = (
        cum.select(*keys, "n", value, F.explode(slots).alias("s"))
        .select(*keys, "n", value, "s.slot", "s.w")
        .where("w <> 0")
    )
    each = hits.groupBy(*keys, "slot").agg(
        F.max("n").alias("n"), F.sum(F.col("w") * F.col(value)).alias("q"))
    return each.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "q"))),
                    lambda r: r["q"]).alias(name))


def quantile_grid(
    df: DataFrame,
    keys: list[str],
    value: str,
    points: int,
    split: bool | None = None,
) -> DataFrame:
    """(keys, j, q): quantiles at ``points`` equal steps from 0 to 1, one row each.

    Ranks use whole-number arithmetic, so a row of the cumulative table finds the
    grid slots it serves without looking at the others.  ``percentile`` searches
    its whole map once per probability and is much slower for a grid.
    """
    return grid_of(cumulative(df.where(F.col(value).isNotNull()), keys, value, split), keys, value, points)


def grid_of(cum: DataFrame, keys: list[str], value: str, points: int) -> DataFrame:
    """The same from an accumulated table.

    A row gives the slots whose lower rank it holds; the upper rank is in the same row or is the next value,
    so a slot comes from one row and nothing has to meet.
    """
    steps = points - 1
    span = F.col("n") - 1
    ceil_div = lambda a, b: F.floor((a + b - 1) / b).cast("long")
    high = F.col("below") + F.col("cnt") - 1
    # j with floor(j * span / steps) inside [below, high]
    first = ceil_div(F.col("below") * steps, F.greatest(span, F.lit(1)))
    last = F.least(ceil_div((high + 1) * steps, F.greatest(span, F.lit(1))) - 1, F.lit(steps))
    slots = F.when(span == 0, F.sequence(F.lit(0), F.lit(steps)).cast("array<bigint>")).when(last >= first, F.sequence(first, last))
    r = cum.select(*keys, F.col(value).alias("_low"), "above", (high + 1).alias("_end"), "n", F.explode(slots).alias("j"))
    place = F.col("j") * (F.col("n") - 1)
    frac = (place % steps) / F.lit(float(steps))
    inside = F.floor(place / steps) + 1 < F.col("_end")
    upper = F.when(inside | (frac == 0), F.col("_low")).otherwise(F.col("above"))
    return r.select(*keys, F.col("j").cast("int").alias("j"), ((1 - frac) * F.col("_low") + frac * upper).alias("q"))


def median(df: DataFrame, keys: list[str], value: str, name: str = "med") -> DataFrame:
    q = exact_quantiles(df, keys, value, [0.5])
    return q.select(*keys, F.col("q")[0].alias(name))


def median_and_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, med, mad, sd): median, median absolute deviation, sample deviation."""
    med = exact_quantiles(df, keys, value, [0.5]).select(*keys, "n", F.col("q")[0].alias("med"))
    spread = df.groupBy(*keys).agg(F.stddev_samp(value).alias("sd"))
    if keys:
        dev = df.select(*keys, value).join(med.select(*keys, "med"), keys)
    else:
        dev = df.select(value, med.select("med").scalar().alias("med"))
    mad = median(dev.withColumn("_d", F.abs(F.col(value) - F.col("med"))), keys, "_d", "mad")
    if keys:
        return med.join(mad, keys).join(spread, keys)
    return med.select("n", "med", mad.scalar().alias("mad"), spread.scalar().alias("sd"))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Rows with the average rank of their value inside the key (ties share it)."""
    usable = df.where(F.col(value).isNotNull())
    if largest_key(usable, keys)[1] <= session.group_rows(df.sparkSession):
        place = F.rank().over(Window.partitionBy(*keys).orderBy(value))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
        return usable.withColumn(name, place + (ties - 1) / 2)
    cum = cumulative(usable, keys, value, True)
    ranked = cum.select(*keys, value, (F.col("below") + (F.col("cnt") + 1) / 2).alias(name))
    return usable.join(ranked, [*keys, value])
