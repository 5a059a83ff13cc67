"""Grouped statistics of error tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import Series, running, series, with_halo
from tidemark.operators.quantiles import average_ranks, cumulative, exact_quantiles
from tidemark.schema import finite

R = 6


def rounded(df: DataFrame, *columns: str, digits: int = R) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def summary_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"),
        F.max(value).alias("high"), F.stddev_pop(value).alias("sd_pop"), F.stddev_samp(value).alias("sd_samp"))


def tail_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, p90 and p99 per key with the ratio of tail to median."""
    q = exact_quantiles(df.where(finite(value)), keys, value, [0.5, 0.9, 0.99])
    mean = df.where(finite(value)).groupBy(*keys).agg(F.avg(value).alias("mean"))
    return q.join(mean, keys).select(
        *keys, "n", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"),
        F.col("q")[2].alias("p99"), F.try_divide(F.col("q")[2], F.col("q")[0]).alias("tail_ratio"))


def against_baseline(df: DataFrame, keys: list[str], period: str, base: object, value: str, name: str) -> DataFrame:
    """Percent change of a per-period statistic against the base period of its key."""
    basis = df.where(F.col(period) == base).select(*keys, F.col(value).alias("_base"))
    joined = df.join(basis, keys, "left") if keys else df.withColumn(
        "_base", basis.select("_base").scalar())
    return joined.withColumn(name, F.try_divide(F.col(value) - F.col("_base"), F.col("_base")) * 100).drop("_base")


def feature_block(df: DataFrame, keys: list[str], value: str, prefix: str, above: float | None = None) -> DataFrame:
    """mean, p50, p90, p95, p99, max of one feature, and the share above a limit."""
    q = exact_quantiles(df.where(finite(value)), keys, value, [0.5, 0.9, 0.95, 0.99])
    aggs = [F.avg(value).alias(f"{prefix}_mean"), F.max(value).alias(f"{prefix}_max")]
    if above is not None:
        aggs.append(F.avg((F.col(value) > above).cast("double")).alias(f"{prefix}_share_above"))
    flat = df.where(finite(value)).groupBy(*keys).agg(*aggs)
    return flat.join(q, keys).select(*flat.columns, *[
        F.col("q")[i].alias(f"{prefix}_{n}") for i, n in enumerate(["p50", "p90", "p95", "p99"])])


def first_by(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    first = F.min_by(F.struct(*values), F.struct(*order)).alias("_f")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_f.{v}").alias(v) for v in values])


def robust_baseline(df: DataFrame, keys: list[str], value: str, is_base: Column, least: int = 100) -> DataFrame:
    """Median and deviation of the baseline rows of each series.

    Series with fewer than ``least`` baseline rows use all their rows; a deviation
    of nearly zero is replaced by the standard deviation.
    """
    from tidemark.operators.quantiles import median_and_mad

    usable = df.where(finite(value)).withColumn("_base", is_base)
    count = usable.groupBy(*keys).agg(F.count_if("_base").alias("n_base"))
    chosen = usable.join(count, keys).where(F.col("_base") | (F.col("n_base") < least))
    stats = median_and_mad(chosen, keys, value).join(count, keys)
    return stats.select(*keys, "n_base", "med",
                        F.when(F.col("mad") < 1e-9, F.col("sd")).otherwise(F.col("mad")).alias("mad"))


def mode_smallest(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value of each key, the smallest on a tie."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def blocks(s: Series, value: str, size: int, trim: float = 0.0, period: str = "year") -> DataFrame:
    """Whole blocks of ``size`` rows: (trimmed) mean, majority period, centre row.

    The ragged last block is dropped.  Blocks have a fixed length, so grouping by
    series and block number spreads a long series over all tasks.
    """
    df = s.df.withColumn("block", F.floor(F.col(s.idx) / size).cast("long"))
    group = [*s.keys, "block"]
    base = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(finite(value)).alias("_m"), F.max(F.when(
            F.col(s.idx) % size == size // 2, F.col(s.idx))).alias("centre"))
    if trim:
        w = Window.partitionBy(*group).orderBy(value, s.idx)
        usable = df.where(finite(value)).withColumn("_r", F.row_number().over(w)).join(base, group)
        cut = F.floor(F.col("_m") * trim)
        mean = usable.where((F.col("_r") > cut) & (F.col("_r") <= F.col("_m") - cut)).groupBy(
            *group).agg(F.avg(value).alias("block_mean"))
    else:
        mean = df.where(finite(value)).groupBy(*group).agg(F.avg(value).alias("block_mean"))
    major = mode_smallest(df, group, period, period)
    return (base.where(F.col("_n") == size).join(major, group).join(mean, group, "left")
            .select(*group, "centre", period, "block_mean"))


def histogram(df: DataFrame, group: list[str], value: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts and densities in equal bins of a common range, edge included."""
    width = (high - low) / bins
    inside = df.where(F.col(value).between(low, high))
    number = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*group, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = inside.groupBy(*group).agg(F.count(F.lit(1)).alias("_t"))
    return counts.join(total, group).select(
        *group, "bin", (low + F.col("bin") * width).alias("left_edge"), "n",
        (F.col("n") / (F.col("_t") * width)).alias("density"))


def ecdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct finite values with the share of rows at or below each."""
    cum = cumulative(df.where(finite(value)), keys, value)
    return cum.select(*keys, value, ((F.col("below") + F.col("cnt")) / F.col("n")).alias("share"))


def rank_correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman correlation: Pearson of average ranks."""
    both = df.where(finite(x) & finite(y)).select(*keys, x, y)
    ranked = average_ranks(average_ranks(both, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def weight_concentration(df: DataFrame, keys: list[str], weight: str, value: str, tie: str) -> DataFrame:
    """Weighted mean, effective-size ratio and the share of the heaviest rows."""
    n, sw, sww = F.count(F.lit(1)), F.sum(weight), F.sum(F.col(weight) * F.col(weight))
    base = df.groupBy(*keys).agg(
        n.alias("n"), F.try_divide(F.sum(F.col(weight) * F.col(value)), sw).alias("weighted_mean"),
        F.when(sww < 1e-12, 0.0).otherwise(sw * sw / (n * sww)).alias("ess_ratio"))
    ordered = df.select(*keys, weight, tie).withColumn("_neg", -F.col(weight))
    ranked = running(ordered, keys, ["_neg", tie], {"_before": F.lit(1), "_sum": F.col(weight)},
                     {"_n": "_before", "_total": "_sum"})
    top = lambda part: F.sum(F.when(
        F.col("_before") < F.greatest(F.floor(F.col("_n") / part), F.lit(1)), F.col(weight)))
    share = ranked.groupBy(*keys).agg(
        (top(100) / F.max("_total") * 100).alias("top1_share_pct"),
        (top(20) / F.max("_total") * 100).alias("top5_share_pct"))
    return base.join(share, keys)


def frame_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def game_chunks(df: DataFrame, game: str, order: list[str], size: int = 30) -> DataFrame:
    """Ordered units of a game in chunks; the ragged last chunk is kept."""
    s = series(df, [game], order, "_at")
    return s.df.withColumn("window_id", F.floor(F.col("_at") / size).cast("int")).drop("_at")


def autocorrelation(s: Series, value: str, lags: int) -> DataFrame:
    """Autocorrelation at lags 1..K of every series.

    Each chunk carries the K rows in front of it, so the products of a lag are
    formed inside the chunk by an Arrow kernel and only sums leave it.
    """
    import numpy as np
    import pandas as pd

    mean = s.df.groupBy(*s.keys).agg(F.avg(value).alias("_mean"))
    centred = s.df.join(mean, s.keys).select(*s.keys, s.idx, (F.col(value) - F.col("_mean")).alias("_x"))
    chunked = with_halo(s.using(centred), lags)
    keys, idx = list(s.keys), s.idx
    names = {f.name: f.dataType.simpleString() for f in centred.schema.fields}

    def products(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx, kind="stable")
        x, own = pdf["_x"].to_numpy(), pdf["_own"].to_numpy()
        if not own.any():
            return pd.DataFrame(columns=[*keys, "lag", "prod", "n"])
        first = int(np.argmax(own))
        last = first + int(own.sum())
        rows = []
        for k in range(lags + 1):
            a = max(first, k)
            rows.append((k, float(x[a:last] @ x[a - k:last - k]) if a < last else 0.0, last - first))
        out = pd.DataFrame(rows, columns=["lag", "prod", "n"])
        for name, v in zip(keys, key[:len(keys)]):
            out[name] = v
        return out[[*keys, "lag", "prod", "n"]]

    schema = ", ".join(f"`{k}` {names[k]}" for k in keys) + ", lag int, prod double, n bigint"
    parts = chunked.groupBy(*keys, "_chunk").applyInPandas(products, schema)
    sums = parts.groupBy(*keys, "lag").agg(F.sum("prod").alias("prod"), F.sum("n").alias("n"))
    zero = sums.where("lag = 0").select(*keys, F.col("prod").alias("_all"))
    return sums.join(zero, keys).select(*keys, "lag", "n", F.try_divide("prod", "_all").alias("rho"))


def effective_size(acf: DataFrame, keys: list[str]) -> DataFrame:
    """n / (1 + 2 sum rho), summed up to the first lag inside the noise band."""
    weak = F.abs("rho") < 1.96 / F.sqrt("n")
    cut = acf.where("lag > 0").groupBy(*keys).agg(
        F.min(F.when(weak, F.col("lag"))).alias("_first"), F.max("lag").alias("_last"))
    used = acf.where("lag > 0").join(cut, keys)
    return used.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max(F.coalesce("_first", "_last")).alias("cut_lag"),
        F.sum(F.when(F.col("lag") < F.coalesce(F.col("_first"), F.col("_last") + 1), F.col("rho")).otherwise(0.0))
        .alias("_s")).select(*keys, "n", "cut_lag", (F.col("n") / (1 + 2 * F.col("_s"))).alias("n_eff"))
