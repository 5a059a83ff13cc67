"""Ranking of detectors by coverage, false alarms and signal to noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.metrics import smoothed_snr
from tidemark.operators.joins import admissible_or_all


def rank_rule(df: DataFrame, keys: list[str], name: str, tie: list[str]) -> DataFrame:
    """Rank by coverage (high), false alarm rate (low), smoothed SNR (high)."""
    w = Window.partitionBy(*keys).orderBy(
        F.desc("year_coverage"), F.asc("far_per_1k"), F.desc("snr_smooth"), *tie)
    return df.withColumn(name, F.row_number().over(w))


def winners(df: DataFrame, keys: list[str], tie: list[str], limit: float = 0.20) -> DataFrame:
    """Best admissible row of each key, or the best of all when none is admissible."""
    pool = admissible_or_all(df, keys, F.col("far_per_1k") <= limit)
    return rank_rule(pool, keys, "_rank", tie).where("_rank = 1").drop("_rank")


def rank_stability(df: DataFrame, name: str, constants: list[float]) -> DataFrame:
    """The ranking under several smoothing constants of the SNR."""
    spread = df.withColumn("a", F.explode(F.array(*[F.lit(float(a)) for a in constants])))
    spread = spread.withColumn("snr_smooth", smoothed_snr(
        F.col("n_post"), F.col("n_base"), F.col("base_rows"), F.col("post_rows"), F.col("a")))
    return rank_rule(spread, ["a"], "place", [name]).select(
        "a", "place", name, "year_coverage", "far_per_1k", "snr_smooth")
