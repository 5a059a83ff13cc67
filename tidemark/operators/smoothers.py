"""Rolling statistics and smoothers over series of any length."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import smoothing
from tidemark.operators.ordered import Series, framed, map_chunks, running, series


def rolling_mean(s: Series, value: str, w: int, name: str = "smooth") -> DataFrame:
    """Mean of the last ``w`` rows, in built-in window functions."""
    return framed(s, lambda win: {name: F.avg(value).over(win.rowsBetween(-(w - 1), 0))}, w - 1)


def smooth(s: Series, value: str, kind: str, params: dict, name: str = "smooth", carry: list[str] | None = None) -> DataFrame:
    """Any registered smoother; long series are smoothed chunk by chunk."""
    before, after = smoothing.reach(kind, params)
    run = smoothing.SMOOTHERS[kind][0]  # as registered on the driver

    def kernel(pdf: pd.DataFrame, starts: bool, stops: bool) -> pd.DataFrame:
        out = run(pdf[value].to_numpy(dtype=float), params, starts, stops)
        return pdf.assign(**{name: out})

    return map_chunks(s, [value, *(carry or [])], kernel, f"`{name}` double", before, after)


def smoothed(s: Series, value: str, kind: str, params: dict, name: str = "smooth", carry: list[str] | None = None) -> Series:
    return s.using(smooth(s, value, kind, params, name, carry))


def variance_reduction(df: DataFrame, keys: list[str], raw: str, smooth_col: str) -> DataFrame:
    """Share of the raw variance that a smoother removed, in percent."""
    rv, sv = F.var_pop(raw), F.var_pop(smooth_col)
    return df.groupBy(*keys).agg((F.try_divide(rv - sv, rv) * 100).alias("reduction_pct"))


def first_difference(s: Series, value: str, name: str = "diff") -> DataFrame:
    return framed(s, lambda w: {name: F.col(value) - F.lag(value).over(w)}, 1)


def cumulative_sum(s: Series, value: str, name: str = "total") -> DataFrame:
    """Running total with the row itself, in two levels for long series."""
    out = running(s.df, s.keys, [s.idx], {"_before": F.col(value)}, split=None)
    return out.withColumn(name, F.col("_before") + F.col(value)).drop("_before")


def sliding_windows(s: Series, back: int, forth: int, values: list[str], carry: list[str] | None = None) -> DataFrame:
    """Look-back and look-forth arrays at each start of a series.

    There are ``length - back - forth`` starts, so the last possible one is left
    out.  The window that begins at position i is formed on the row i from the
    rows in front of it, one frame per chunk.
    """
    span = back + forth

    def build(win):
        frame = win.rowsBetween(0, span)
        packed = F.struct(*values)
        return {"_w": F.collect_list(packed).over(frame)}

    rows = framed(s, build, 0, span).where(F.size("_w") == span + 1)
    first = [F.slice("_w", 1, back)[v].alias(f"past_{v}") for v in values]
    after = [F.slice("_w", back + 1, forth)[v].alias(f"future_{v}") for v in values]
    return rows.select(*s.keys, s.idx, *(carry or []), *first, *after)


def boundaries(s: Series, period: str) -> DataFrame:
    """First position and row count of each period of a series."""
    return s.df.groupBy(*s.keys, period).agg(
        F.min(s.idx).alias("boundary"), F.count(F.lit(1)).alias("n_rows"))


def first_after(bounds: DataFrame, alarms: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """First alarm inside the stretch of each period, with its delay."""
    b, a = bounds.alias("b"), alarms.select(*keys, F.col(idx).alias("_at")).alias("a")
    inside = (F.col("_at") >= F.col("boundary")) & (F.col("_at") < F.col("boundary") + F.col("n_rows"))
    cond = inside
    for k in keys:
        cond = cond & (F.col(f"b.{k}") == F.col(f"a.{k}"))
    hit = b.join(a, cond, "left").groupBy(*[F.col(f"b.{c}") for c in bounds.columns]).agg(
        F.min("_at").alias("first_alarm"), F.count("_at").alias("n_alarms"))
    return hit.withColumn("delay", F.col("first_alarm") - F.col("boundary"))


def mean_split_scores(s: Series, value: str, max_window: int) -> DataFrame:
    """z of the two halves of the growing (then fixed) window at every row.

    Prefix sums come from the two-level running sums; the sums at the two cuts of
    a row are fetched by position, so the whole statistic is joins and
    arithmetic.  Up to the first alarm it is what the detector sees.
    """
    x = F.col(value)
    cum = running(s.df.select(*s.keys, s.idx, value), s.keys, [s.idx], {"_s": x, "_q": x * x}, split=None)
    i = F.col(s.idx)
    length = F.least(i + 1, F.lit(max_window))
    left = i - length + 1
    rows = cum.withColumns({
        "_n": length, "_left": left, "_cut": left + F.floor(length / 2),
        "_send": F.col("_s") + x, "_qend": F.col("_q") + x * x})
    at = lambda n: cum.select(*s.keys, F.col(s.idx).alias(f"_{n}"), F.col("_s").alias(f"_s_{n}"), F.col("_q").alias(f"_q_{n}"))
    j = rows.join(at("left"), [*s.keys, "_left"]).join(at("cut"), [*s.keys, "_cut"])
    na = (F.col("_cut") - F.col("_left")).cast("double")
    nb = (i - F.col("_cut") + 1).cast("double")
    sa, sb = F.col("_s_cut") - F.col("_s_left"), F.col("_send") - F.col("_s_cut")
    qa, qb = F.col("_q_cut") - F.col("_q_left"), F.col("_qend") - F.col("_q_cut")
    var = lambda q, t, n: F.try_divide(F.greatest(q - t * t / n, F.lit(0.0)), n - 1)
    sd = F.sqrt(F.try_divide(var(qa, sa, na), na) + F.try_divide(var(qb, sb, nb), nb))
    gap = F.abs(F.try_divide(sa, na) - F.try_divide(sb, nb))
    usable = (na >= 2) & (nb >= 2)
    return j.where(usable).select(
        *s.keys, s.idx, F.col("_n").alias("length"), F.when(sd >= 1e-9, gap / sd).alias("z"))


def hinkley_scores(s: Series, value: str, slack: float) -> DataFrame:
    """Page-Hinkley excess at every row, without resets.

    Three running passes: the mean, the sum of deviations, and its minimum (not
    above zero).  The minimum is a running extreme, taken per partition and then
    against the extremes of the partitions in front.
    """
    x = F.col(value)
    a = running(s.df.select(*s.keys, s.idx, value), s.keys, [s.idx], {"_s": x}, split=None)
    a = a.withColumn("_dev", x - (F.col("_s") + x) / (F.col(s.idx) + 1) - slack)
    b = running(a, s.keys, [s.idx], {"_before": F.col("_dev")}, split=None)
    b = b.withColumn("_sum", F.col("_before") + F.col("_dev"))
    low = running_minimum(s.using(b), "_sum", "_low")
    return low.select(*s.keys, s.idx, (F.col("_sum") - F.least(F.col("_low"), F.lit(0.0))).alias("excess"))


def running_minimum(s: Series, value: str, name: str) -> DataFrame:
    """Minimum of all rows up to this one: inside the chunk and over earlier chunks."""
    from tidemark.operators.ordered import with_halo

    df = with_halo(s).drop("_own")
    lows = df.groupBy(*s.keys, "_chunk").agg(F.min(value).alias("_cm"))
    w = Window.partitionBy(*s.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = lows.select(*s.keys, "_chunk", F.min("_cm").over(w).alias("_earlier"))
    local = Window.partitionBy(*s.keys, "_chunk").orderBy(s.idx).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_here", F.min(value).over(local)).join(before, [*s.keys, "_chunk"])
    return out.withColumn(name, F.least("_here", "_earlier")).drop("_here", "_earlier", "_chunk")


def first_crossing(scores: DataFrame, keys: list[str], score: str, limit, ready, idx: str = "idx") -> DataFrame:
    return scores.where((F.col(score) > limit) & ready).groupBy(*keys).agg(F.min(idx).alias("first_alarm"))


def interleaved(df: DataFrame, game: str, track: list[str], time: str) -> DataFrame:
    """Tracks of both teams in order of their first time stamp."""
    starts = df.groupBy(game, *track).agg(F.min(time).alias("t0"), F.count(F.lit(1)).alias("n"))
    return series(starts, [game], ["t0", *track], "place").df


