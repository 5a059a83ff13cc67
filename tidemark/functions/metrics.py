"""Detector and interval metrics as column expressions, also for SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PERFECT = 9999.0


def far_per_1k(base_alarms: Column, base_rows: Column) -> Column:
    return 1000.0 * base_alarms / F.greatest(F.lit(1), base_rows)


def operational_snr(post: Column, base: Column, base_rows: Column, post_rows: Column) -> Column:
    """Alarm rate after over alarm rate in the baseline; a sentinel without the latter."""
    # products of counts leave the range of a long, so they are taken as doubles
    p, b, br, pr = (c.cast("double") for c in (post, base, base_rows, post_rows))
    rate = F.try_divide(p * br, b * pr)
    return F.least(
        F.when(base == 0, F.when(post > 0, PERFECT).otherwise(0.0))
        .when(post_rows == 0, 0.0).otherwise(rate), F.lit(PERFECT))


def smoothed_snr(post: Column, base: Column, base_rows: Column, post_rows: Column, a: Column | float = 1.0) -> Column:
    a = a if isinstance(a, Column) else F.lit(float(a))
    return F.coalesce(F.try_divide((post + a) * base_rows, (base + a) * post_rows), F.lit(0.0))


def detection_efficiency(post: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(post.cast("double"), total.cast("double")), F.lit(0.0))


def year_coverage(counts: list[Column]) -> Column:
    out = F.lit(0)
    for c in counts:
        out = out + F.when(c > 0, 1).otherwise(0)
    return out


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k out of n, per thousand; (0, 0) without rows."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    inverse = F.try_divide(F.lit(1.0), n)
    denom = 1 + z * z * inverse
    centre = (p + z * z / 2 * inverse) / denom
    half = (z / denom) * F.sqrt(p * (1 - p) * inverse + z * z / 4 * inverse * inverse)
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half) * 1000.0).otherwise(0.0)
    high = F.when(n > 0, (centre + half) * 1000.0).otherwise(0.0)
    return low, high


def register_sql(spark: SparkSession) -> None:
    """The same metrics as SQL functions for ``spark.sql``."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION far_per_1k(k BIGINT, n BIGINT) RETURNS DOUBLE
                 RETURN 1000.0D * k / greatest(1, n)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION smoothed_snr(
                   post BIGINT, base BIGINT, base_rows BIGINT, post_rows BIGINT) RETURNS DOUBLE
                 RETURN coalesce(try_divide((post + 1.0D) * base_rows, (base + 1.0D) * post_rows), 0.0D)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION wilson_high(k BIGINT, n BIGINT) RETURNS DOUBLE
                 RETURN CASE WHEN n > 0 THEN 1000.0D * (CAST(k AS DOUBLE) / n + 3.8416D / (2 * n)
                   + 1.96D * sqrt(CAST(k AS DOUBLE) / n * (1 - CAST(k AS DOUBLE) / n) / n
                   + 3.8416D / (4.0D * n * n))) / (1 + 3.8416D / n) ELSE 0.0D END""")
