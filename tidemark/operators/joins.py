"""Joins of the drift pipeline: lookups, pairs within a band, nearest, history."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import running, series
from tidemark.schema import assert_unique


class MissingRows(ValueError):
    """A left join left too many rows without a partner."""


def small(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """Mark for broadcast, but only if counting stops below the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def context_join(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Left join where columns present on both sides come with a prefix."""
    renamed = right.select(*keys, *[
        F.col(c).alias(f"{prefix}{c}" if c in left.columns else c) for c in right.columns if c not in keys])
    return left.join(renamed, keys, "left")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], probe: str, most_missing: float = 0.01) -> DataFrame:
    """Left join on a key unique on both sides; fails when too much is missing."""
    assert_unique(left, keys)
    assert_unique(right, keys)
    out = left.join(right, keys, "left")
    row = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(probe).isNull()).alias("m")).first()
    if row["m"] > most_missing * row["n"]:
        raise MissingRows(f"{row['m']} of {row['n']} rows without {probe}")
    return out


def lookup(left: DataFrame, dim: DataFrame, keys: list[str], value: str, default: object = None,
           inferred: Column | None = None) -> DataFrame:
    """Dimension value, preferring an inferred one and ending in a default."""
    joined = left.join(small(dim.select(*keys, value)), keys, "left")
    parts = [p for p in (inferred, F.col(value)) if p is not None]
    if default is not None:
        parts.append(F.lit(default))
    return joined.withColumn(value, F.coalesce(*parts))


def band_pairs(left: DataFrame, right: DataFrame, left_n: str, right_n: str, tol: float) -> DataFrame:
    """Pairs with |left - right| / right <= tol, found by bands of the logarithm.

    A band is as wide as the widest admissible ratio, so partners lie in the same
    band or next to it and the theta condition becomes an equi-join plus a filter.
    """
    width = max(math.log1p(tol), -math.log1p(-tol)) + 1e-9
    band = lambda c: F.floor(F.log(F.col(c).cast("double")) / width).cast("long")
    a = left.withColumn("_band", F.explode(F.sequence(band(left_n) - 1, band(left_n) + 1)))
    b = right.withColumn("_band", band(right_n))
    gap = F.abs(F.col(left_n) - F.col(right_n)) / F.col(right_n)
    return a.join(b, "_band").where(gap <= tol).drop("_band")


def band_aggregate(left: DataFrame, right: DataFrame, left_n: str, right_n: str, right_value: str, tol: float) -> DataFrame:
    """Count and sum of the partners of each left row, without forming pairs.

    Partners of n are the right rows in [n/(1+tol), n/(1-tol)].  Right rows are
    merged by size, accumulated in order of size, and read at both ends.
    """
    sizes = right.groupBy(F.col(right_n).cast("double").alias("_at")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(right_value).alias("_s"))
    zero = lambda t: F.lit(0).cast(t)
    rows = left.withColumn("_id", F.monotonically_increasing_id())
    ask = rows.select("_id", (F.col(left_n) / (1 + tol)).alias("_lo"), (F.col(left_n) / (1 - tol)).alias("_hi"))
    # at equal positions a lower end comes before the sizes, an upper end after
    low = ask.select("_id", F.col("_lo").alias("_at"), F.lit(0).alias("_turn"))
    high = ask.select("_id", F.col("_hi").alias("_at"), F.lit(2).alias("_turn"))
    axis = sizes.select(F.lit(-1).cast("bigint").alias("_id"), "_at", F.lit(1).alias("_turn"), "_c", "_s").unionByName(
        low.unionByName(high).select("_id", "_at", "_turn", zero("bigint").alias("_c"), zero("double").alias("_s")))
    cum = running(axis, [], ["_at", "_turn", "_id"], {"c": F.col("_c"), "s": F.col("_s")})
    sign = F.when(F.col("_turn") == 2, 1).otherwise(-1)
    ends = cum.where("_turn <> 1").groupBy("_id").agg(
        F.sum(sign * F.col("c")).alias("n_pairs"), F.sum(sign * F.col("s")).alias("partner_sum"))
    return rows.join(ends, "_id").drop("_id")


def nearest(a: DataFrame, b: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Each row of ``a`` with the closest position in ``b`` (the later on a tie).

    Both sides are put on one axis; the last partner before and the first after
    come from running maxima, so no pair is formed.
    """
    axis = a.select(*keys, idx, F.lit(1).alias("_a")).unionByName(
        b.select(*keys, idx, F.lit(0).alias("_a")))
    s = series(axis, keys, [idx, "_a"], "_pos")
    # position of the partner just before: partners are numbered, then looked up
    partner = F.when(F.col("_a") == 0, 1).otherwise(0)
    numbered = running(s.df, keys, ["_pos"], {"_before": partner})
    asked = numbered.where("_a = 1").select(*keys, idx, F.col("_before").alias("_no"))
    known = numbered.where("_a = 0").select(*keys, F.col("_before").alias("_no"), F.col(idx).alias("_b"))
    prev = known.select(*keys, (F.col("_no") + 1).alias("_no"), F.col("_b").alias("_prev"))
    nxt = known.select(*keys, "_no", F.col("_b").alias("_next"))
    out = asked.join(prev, [*keys, "_no"], "left").join(nxt, [*keys, "_no"], "left")
    back, ahead = F.col(idx) - F.col("_prev"), F.col("_next") - F.col(idx)
    take_next = F.col("_next").isNotNull() & (F.col("_prev").isNull() | (ahead <= back))
    return out.select(
        *keys, idx, F.when(take_next, F.col("_next")).otherwise(F.col("_prev")).alias("partner"),
        F.when(take_next, ahead).otherwise(back).alias("gap"))


def closest_pair(a: DataFrame, b: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Smallest distance between two sets of positions, with the pair."""
    near = nearest(a, b, keys, idx).where("gap IS NOT NULL")
    return near.groupBy(*keys).agg(
        F.min("gap").alias("delta_min"),
        F.min_by(F.struct(idx, "partner"), F.struct("gap", idx)).alias("_p")).select(
            *keys, "delta_min", F.col(f"_p.{idx}").alias("a_idx"), F.col("_p.partner").alias("b_idx"))


def history(
    asks: DataFrame, partners: DataFrame, keys: list[str], time: str, ask_id: str, tie: str,
    values: list[str], depth: int,
) -> DataFrame:
    """The last ``depth`` partner rows strictly before each ask, padded in front.

    Partners are numbered by time; an ask learns how many lie before it and then
    fetches those numbers.  Missing history repeats the first partner row and is
    marked false in ``mask``; without any partner all slots are NULL and false.
    """
    axis = partners.select(
        *keys, time, F.lit(1).alias("_turn"), F.col(tie).alias("_tie"), F.struct(*values).alias("_v"),
        F.lit(1).alias("_one")).unionByName(
        asks.select(*keys, time, F.lit(0).alias("_turn"), F.col(ask_id).alias("_tie"),
                    F.lit(None).cast(partners.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_v"),
                    F.lit(0).alias("_one")))
    cum = running(axis, keys, [time, "_turn", "_tie"], {"_no": F.col("_one")})
    known = cum.where("_turn = 1").select(*keys, "_no", "_v")
    asked = cum.where("_turn = 0").select(
        *keys, F.col("_tie").alias(ask_id), F.col("_no").alias("_end"),
        F.posexplode(F.sequence(F.col("_no") - depth, F.col("_no") - 1)).alias("_slot", "_want"))
    asked = asked.withColumn("_no", F.greatest(F.col("_want"), F.lit(0)))
    got = asked.join(known, [*keys, "_no"], "left")
    packed = F.array_sort(F.collect_list(F.struct(
        "_slot", (F.col("_want") >= 0).alias("mask"), "_v")))
    return got.groupBy(*keys, ask_id).agg(packed.alias("_h")).select(
        *keys, ask_id, *[F.col(f"_h._v.{v}").alias(v) for v in values], F.col("_h.mask").alias("mask"))


def expand(df: DataFrame, grid: list[dict], columns: dict[str, str]) -> DataFrame:
    """Every row with every configuration of a small grid, without a join."""
    rows = [F.struct(*[F.lit(g[c]).cast(t).alias(c) for c, t in columns.items()]) for g in grid]
    return df.withColumn("_g", F.explode(F.array(*rows))).select(
        *df.columns, *[F.col(f"_g.{c}").alias(c) for c in columns])


def admissible_or_all(df: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Rows that pass a limit, or all rows of a key when none passes."""
    any_ok = df.groupBy(*keys).agg(F.bool_or(ok).alias("_any"))
    return df.join(any_ok, keys).where(ok | ~F.col("_any")).drop("_any")
