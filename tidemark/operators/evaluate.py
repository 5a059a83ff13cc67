"""Alarm tables turned into rates, coverage, latency and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.operators.ordered import Series
from tidemark.operators.smoothers import boundaries, first_after


def alarm_years(alarms: DataFrame, bounds: DataFrame, keys: list[str], idx: str = "idx", period: str = "year") -> DataFrame:
    """The period an alarm falls in, from the few boundaries of its series."""
    a = alarms.join(bounds, keys)
    return a.where((F.col(idx) >= F.col("boundary")) & (F.col(idx) < F.col("boundary") + F.col("n_rows"))).select(
        *alarms.columns, period)


def evaluate(
    alarms: DataFrame, s: Series, names: list[str], base: int, post: list[int], by: str = "cfg", period: str = "year",
    per: int = 1,
) -> DataFrame:
    """One row per series and configuration, also for those without any alarm.

    ``per`` divides the row counts when alarms are counted in blocks of rows.
    """
    bounds = boundaries(s, period)
    return score(alarm_years(alarms, bounds, s.keys, s.idx, period), bounds, s.keys, names, base, post, by, period, per)


def score(
    dated: DataFrame, bounds: DataFrame, keys: list[str], names: list[str], base: int, post: list[int], by: str = "cfg",
    period: str = "year", per: int = 1,
) -> DataFrame:
    """Metrics from alarms that carry their period."""
    rows = lambda c: F.greatest(F.lit(1), F.floor(F.coalesce(F.sum(F.when(c, F.col("n_rows"))), F.lit(0)) / per))
    plain = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_rows"))), F.lit(0)).cast("bigint")
    size = rows if per > 1 else plain
    totals = bounds.groupBy(*keys).agg(
        size(F.col(period) == base).cast("bigint").alias("base_rows"),
        size(F.col(period).isin(post)).cast("bigint").alias("post_rows"))
    count = lambda c: F.count_if(c)
    found = dated.groupBy(*keys, by).agg(
        F.count(F.lit(1)).alias("n_alarms"), count(F.col(period) == base).alias("n_base"),
        count(F.col(period).isin(post)).alias("n_post"), *[count(F.col(period) == y).alias(f"n_{y}") for y in post])
    every = totals.withColumn(by, F.explode(F.array(*[F.lit(n) for n in names])))
    counts = ["n_alarms", "n_base", "n_post", *[f"n_{y}" for y in post]]
    out = every.join(found, [*keys, by], "left").fillna(0, counts)
    return with_metrics(out, post)


def with_metrics(df: DataFrame, post: list[int]) -> DataFrame:
    p, b, br, pr = (F.col(c) for c in ("n_post", "n_base", "base_rows", "post_rows"))
    return df.select(
        "*", metrics.far_per_1k(b, br).alias("far_per_1k"), metrics.year_coverage([F.col(f"n_{y}") for y in post]).alias("year_coverage"),
        metrics.smoothed_snr(p, b, br, pr).alias("snr_smooth"), metrics.operational_snr(p, b, br, pr).alias("snr_op"),
        metrics.detection_efficiency(p, F.col("n_alarms")).alias("efficiency"))


def latency(alarms: DataFrame, s: Series, names: list[str], post: list[int], games: DataFrame, by: str = "cfg", period: str = "year") -> DataFrame:
    """Delay of the first alarm of each period in rows, games and percent of the period."""
    bounds = boundaries(s, period).where(F.col(period).isin(post))
    per = bounds.join(games, [*s.keys, period]).withColumn(by, F.explode(F.array(*[F.lit(n) for n in names])))
    hit = first_after(per, alarms, [*s.keys, by], s.idx)
    rows_per_game = F.col("n_rows") / F.greatest(F.lit(1), F.col("n_games"))
    return hit.select(
        *s.keys, by, period, "boundary", "first_alarm", "delay", (F.col("delay") / rows_per_game).alias("delay_games"),
        (100.0 * F.col("delay") / F.col("n_rows")).alias("delay_pct"), "n_alarms")


def games_per_period(df: DataFrame, keys: list[str], period: str, game: str) -> DataFrame:
    return df.select(*keys, period, game).distinct().groupBy(*keys, period).agg(F.count(F.lit(1)).alias("n_games"))


def with_wilson(df: DataFrame, k: str = "n_base", n: str = "base_rows") -> DataFrame:
    low, high = metrics.wilson(F.col(k), F.col(n))
    return df.withColumn("wilson_lo", low).withColumn("wilson_hi", high)


def master_table(scores: DataFrame, role: Column, limit: float = 0.20) -> DataFrame:
    """All detectors: admissible ones ranked, then inadmissible, then negative results."""
    from pyspark.sql import Window

    negative = F.startswith(role, F.lit("negative"))
    section = F.when(negative, 2).when(F.col("far_per_1k") > limit, 1).otherwise(0)
    w = Window.partitionBy("section").orderBy(
        F.desc("year_coverage"), F.asc("far_per_1k"), F.desc("snr_smooth"), "detector")
    return scores.withColumn("section", section).withColumn("place", F.when(F.col("section") == 0, F.row_number().over(w)))


def inconsistent(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of one result table that the other does not confirm; empty when they agree."""
    return left.select(*keys, *values).exceptAll(right.select(*keys, *values))
