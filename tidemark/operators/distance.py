"""Distances between samples: Kolmogorov-Smirnov and Wasserstein, per key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark import session
from tidemark.operators.ordered import running
from tidemark.operators.joins import small
from tidemark.operators.quantiles import accumulated, cumulative, grid_of, quantile_grid, value_counts
from tidemark.schema import finite

GRID = 2000
#: Largest product of the two sizes for which a p-value is counted over all orders of the pooled rows.
KS_EXACT = 10_000
#: Terms of the limiting series, and the scaled distance below which its sum is 1 to twelve digits.
KS_TERMS = 100
KS_NEAR_ZERO = 0.2


def ks_two_sample(df: DataFrame, keys: list[str], value: str, in_a: Column) -> DataFrame:
    """KS statistic of two samples per key; equal values count once, as in an ECDF."""
    counts = df.where(finite(value)).groupBy(*keys, value).agg(
        F.count_if(in_a).alias("_a"), F.count_if(~in_a).alias("_b"))
    cum = running(counts, keys, [value], {"_ca": F.col("_a"), "_cb": F.col("_b")}, {"_na": "_ca", "_nb": "_cb"})
    fa = F.try_divide((F.col("_ca") + F.col("_a")).cast("double"), F.col("_na"))
    fb = F.try_divide((F.col("_cb") + F.col("_b")).cast("double"), F.col("_nb"))
    return cum.groupBy(*keys).agg(
        F.max("_na").alias("n_a"), F.max("_nb").alias("n_b"), F.max(F.abs(fa - fb)).alias("ks"))


@F.pandas_udf(DoubleType())
def _order_share(n_a: pd.Series, n_b: pd.Series, gap: pd.Series, ends: pd.Series) -> pd.Series:
    """Share of the orders of the pooled rows whose largest gap, at the ends of equal values, reaches ``gap``.

    Rows are dealt one by one without replacement; a path that reaches the gap is taken out and counted.
    """
    out = []
    for n, m, most, stops in zip(n_a, n_b, gap, ends):
        if not len(stops):  # counted by the series instead
            out.append(1.0)
            continue
        n, m, stops, reached = int(n), int(m), set(stops), 0.0
        i, alive = np.arange(n + 1), np.zeros(n + 1)
        alive[0] = 1.0
        for t in range(n + m):
            from_a = alive * (n - i) / (n + m - t)
            alive = alive - from_a
            alive[1:] += from_a[:-1]
            if t + 1 in stops:
                far = np.abs(i * m - (t + 1 - i) * n) >= most
                reached += alive[far].sum()
                alive[far] = 0.0
        out.append(min(reached, 1.0))
    return pd.Series(out, dtype=float)


def ks_p_values(df: DataFrame, keys: list[str], value: str, in_a: Column, exact: int = KS_EXACT) -> DataFrame:
    """KS statistic of two samples per key with its p-value.

    Where the product of the sizes is at most ``exact`` the p-value is that over all orders of the
    pooled rows, with equal values in place (so at most ``exact`` + 1 positions of a key meet in a row);
    beyond, it is the sum of the limiting series. A key without rows on one side has neither.
    """
    counts = df.where(finite(value)).groupBy(*keys, value).agg(F.count_if(in_a).alias("_a"), F.count_if(~in_a).alias("_b"))
    cum = running(counts, keys, [value], {"_ca": F.col("_a"), "_cb": F.col("_b")}, {"_na": "_ca", "_nb": "_cb"})
    a, b, pairs = F.col("_ca") + F.col("_a"), F.col("_cb") + F.col("_b"), F.col("_na") * F.col("_nb")
    found = cum.where(pairs > 0).groupBy(*keys).agg(
        F.max("_na").alias("n_a"), F.max("_nb").alias("n_b"), F.max(F.abs(a * F.col("_nb") - b * F.col("_na"))).alias("_gap"),
        F.collect_list(F.when(pairs <= exact, a + b)).alias("_ends"))
    n, m = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    scaled = F.col("_gap") / F.sqrt(n * m * (n + m))
    term = lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * scaled * scaled)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), term)
    limit = F.when(scaled < KS_NEAR_ZERO, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))
    return found.select(*keys, "n_a", "n_b", (F.col("_gap") / (n * m)).alias("ks"),
                        F.when(F.size("_ends") > 0, _order_share("n_a", "n_b", "_gap", "_ends")).otherwise(limit).alias("p"))


def ks_against(df: DataFrame, keys: list[str], value: str, base: DataFrame, shared: list[str] | None = None) -> DataFrame:
    """KS of every key against one common baseline (one per ``shared`` column).

    Between two values of a key its own ECDF is flat and that of the baseline
    rises, so the largest gap is found at a value of the key or just before one.
    All values are put on one axis and read the baseline counts there; the
    baseline is never copied per key.
    """
    shared = shared or []
    own = cumulative(df.where(finite(value)), keys, value)
    return _ks(own, keys, value, value_counts(base.where(finite(value)), shared, value), shared)


def _ks(own: DataFrame, keys: list[str], value: str, base: DataFrame, shared: list[str]) -> DataFrame:
    """KS from the accumulated values of the keys and the counted ones of the baseline."""
    marks = own.select(*shared, value).distinct().withColumn("_cnt", F.lit(0).cast("bigint"))
    counted = base.select(*shared, value, F.col("cnt").alias("_cnt"))
    axis = marks.unionByName(counted).groupBy(*shared, value).agg(F.sum("_cnt").alias("_cnt"))
    b = running(axis, shared, [value], {"_bb": F.col("_cnt")}, {"_nb": "_bb"}).select(
        *shared, value, "_bb", (F.col("_bb") + F.col("_cnt")).alias("_be"), "_nb")
    j = own.join(b, [*shared, value])
    ratio = lambda a, n: F.try_divide(a.cast("double"), n.cast("double"))
    at = F.abs(ratio(F.col("below") + F.col("cnt"), F.col("n")) - ratio(F.col("_be"), F.col("_nb")))
    before = F.abs(ratio(F.col("below"), F.col("n")) - ratio(F.col("_bb"), F.col("_nb")))
    return j.groupBy(*keys).agg(F.max(F.greatest(at, before)).alias("ks"), F.max("n").alias("n"))


def wasserstein_two_sample(df: DataFrame, keys: list[str], value: str, in_a: Column, points: int = GRID) -> DataFrame:
    """Mean absolute difference of the quantile grids of two samples per key."""
    usable = df.where(finite(value)).withColumn("_side", in_a)
    grid = quantile_grid(usable.select(*keys, "_side", value), [*keys, "_side"], value, points)
    both = grid.groupBy(*keys, "j").agg(
        F.max(F.when(F.col("_side"), F.col("q"))).alias("_a"), F.max(F.when(~F.col("_side"), F.col("q"))).alias("_b"))
    return both.groupBy(*keys).agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("wd"))


def wasserstein_against(
    df: DataFrame, keys: list[str], value: str, base: DataFrame, shared: list[str] | None = None, points: int = GRID
) -> DataFrame:
    """Wasserstein distance of every key to one common baseline."""
    shared = shared or []
    own = cumulative(df.where(finite(value)), keys, value)
    return _wasserstein(own, keys, value, cumulative(base.where(finite(value)), shared, value), shared, points)


def _wasserstein(own: DataFrame, keys: list[str], value: str, base: DataFrame, shared: list[str], points: int = GRID) -> DataFrame:
    """Wasserstein distance from the accumulated values of both sides."""
    ref = session.cut(grid_of(base, shared, value, points).withColumnRenamed("q", "_b"))
    joined = grid_of(own, keys, value, points).join(small(ref), [*shared, "j"])
    return joined.groupBy(*keys).agg(F.avg(F.abs(F.col("q") - F.col("_b"))).alias("wd"))


def shift_table(
    df: DataFrame, keys: list[str], value: str, base: DataFrame, shared: list[str] | None = None, store: bool = False
) -> DataFrame:
    """KS and Wasserstein of every key against the baseline.

    Values are read and counted once, and both statistics go on from the counts. ``store`` writes the
    values to the checkpoint folder first, for a baseline that shares a costly input with the keys.
    """
    shared = shared or []
    if store:
        df = session.cut(df.select(*keys, value))
        base = session.cut(base.select(*shared, value))
    counts = session.cut(value_counts(df.where(finite(value)), keys, value))
    counted = session.cut(value_counts(base.where(finite(value)), shared, value))
    # a key gives up to GRID slots however few bytes it has, so partitions are not merged by their size
    dealt = counts.repartition(session.parallelism(df.sparkSession), *keys)
    own = accumulated(dealt, keys, value)
    return _ks(own, keys, value, counted, shared).join(
        _wasserstein(own, keys, value, accumulated(counted, shared, value), shared), keys)


def melt_features(df: DataFrame, ids: list[str], features: dict[str, Column]) -> DataFrame:
    """One row per feature value: the features are stacked before the distances."""
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value")) for n, c in features.items()])
    return df.select(*ids, F.explode(rows).alias("_f")).select(*ids, "_f.feature", "_f.value")


def median_distance(df: DataFrame, columns: list[str], row_id: str, most: int = 2000, seed: int = 42) -> float:
    """Median positive Euclidean distance within a hashed sample of bounded size.

    The sample is the operator's own definition (at most ``most`` rows), so the
    pairs inside it are formed in memory by one task.
    """
    from tidemark.operators.sampling import hash_cap

    sample = hash_cap(df.select(row_id, *columns), [], row_id, most, seed)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[columns].to_numpy(dtype=float)
        d = np.sqrt(_square(x)[np.triu_indices(len(x), k=1)])
        d = d[d > 0]
        return pd.DataFrame({"sigma": [float(np.median(d)) if len(d) else 1.0]})

    row = sample.groupBy(F.lit(0).alias("_g")).applyInPandas(pairs, "sigma double").first()
    return float(row["sigma"]) if row else 1.0


def _square(x):
    """Squared distances between all rows of a bounded sample."""
    n = (x * x).sum(axis=1)
    return np.maximum(n[:, None] + n[None, :] - 2.0 * (x @ x.T), 0.0)
