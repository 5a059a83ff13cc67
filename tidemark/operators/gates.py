"""Alarm gates: union, coincidence of two channels, debounced nearest pairs.

A gate is a small state machine over the merged alarms of a series, so it runs
as a detector over an event series.  An event is one number: twice the position
plus the channel.
"""

from __future__ import annotations



import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.detectors import kernels
from tidemark.operators.detectors.linked import detect
from tidemark.operators.joins import nearest
from tidemark.operators.ordered import series

NEVER = -1e18


class Coincidence:
    """Fires when the other channel was heard within W; both are then forgotten."""

    settles = True

    @staticmethod
    def reach(p: dict) -> int:
        return int(p.get("warm", 512))

    @staticmethod
    def cold(p: dict) -> list[float]:
        return [NEVER, NEVER, NEVER]

    @staticmethod
    def run(p, state, pre, x, lead):
        last, heard = state[0], [state[1], state[2]]
        width, pause = float(p["W"]), float(p["debounce"])
        fired = []
        for i, code in enumerate(x):
            at, channel = divmod(int(code), 2)
            heard[channel] = float(at)
            if at - heard[1 - channel] <= width and at - last > pause:
                fired.append(i)
                last, heard = float(at), [NEVER, NEVER]
        return np.asarray(fired, dtype=np.int64), [last, *heard]


class Pause:
    """Passes an event when at least ``debounce`` lies behind the last one passed."""

    settles = True

    @staticmethod
    def reach(p: dict) -> int:
        return int(p.get("warm", 512))

    @staticmethod
    def cold(p: dict) -> list[float]:
        return [NEVER]

    @staticmethod
    def run(p, state, pre, x, lead):
        last, fired = state[0], []
        for i, at in enumerate(x):
            if at - last >= p["debounce"]:
                fired.append(i)
                last = float(at)
        return np.asarray(fired, dtype=np.int64), [last]


kernels.register("coincidence", Coincidence)
kernels.register("pause", Pause)


def or_gate(a: DataFrame, b: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    return a.select(*keys, idx).union(b.select(*keys, idx)).distinct()


def and_gate(a: DataFrame, b: DataFrame, keys: list[str], widths: list[int], debounce: int, idx: str = "idx") -> DataFrame:
    """Confirmed positions for each coincidence width: keys, ``W``, position."""
    merged = a.select(*keys, idx, F.lit(0).alias("channel")).unionByName(
        b.select(*keys, idx, F.lit(1).alias("channel")))
    s = series(merged, keys, [idx, "channel"], "_event")
    coded = s.using(s.df.withColumn("_code", (F.col(idx) * 2 + F.col("channel")).cast("double")))
    configs = [{"cfg": str(w), "detector": "coincidence", "W": w, "debounce": debounce} for w in widths]
    hits = detect(coded, "_code", configs)
    return hits.join(s.df.select(*keys, "_event", idx), [*keys, "_event"]).select(
        *keys, F.col("cfg").cast("int").alias("W"), idx)


def nearest_gate(a: DataFrame, b: DataFrame, keys: list[str], widths: list[int], debounce: int, idx: str = "idx") -> DataFrame:
    """Alarms of ``a`` with a partner within W, at the later position, debounced."""
    near = nearest(a, b, keys, idx)
    wide = near.withColumn("W", F.explode(F.array(*[F.lit(w) for w in widths]))).where(F.col("gap") <= F.col("W"))
    wide = wide.withColumn("_t", F.greatest(F.col(idx), F.col("partner")).cast("double"))
    s = series(wide, [*keys, "W"], [idx], "_event")
    hits = detect(s, "_t", [{"cfg": "pause", "detector": "pause", "debounce": debounce}])
    return hits.join(s.df.select(*keys, "W", "_event", "_t"), [*keys, "W", "_event"]).select(
        *keys, "W", F.col("_t").cast("bigint").alias(idx))


def channel_table(named: dict[str, DataFrame], keys: list[str], idx: str = "idx") -> DataFrame:
    """Union of named alarm sets with one flag per name."""
    parts = None
    for name, df in named.items():
        row = df.select(*keys, idx, *[F.lit(n == name).alias(n) for n in named])
        parts = row if parts is None else parts.unionByName(row)
    return parts.groupBy(*keys, idx).agg(*[F.bool_or(n).alias(n) for n in named])


def two_tier(primary: DataFrame, block: DataFrame, other: DataFrame, keys: list[str], width: int, debounce: int) -> DataFrame:
    """Confirmed (primary and block) and suspected (primary or other) alarms."""
    confirmed = and_gate(primary, block, keys, [width], debounce).drop("W")
    return channel_table({
        "confirmed": confirmed, "suspected": or_gate(primary, other, keys),
        "adwin_alarm": primary, "ph_alarm": block, "kalman_alarm": other}, keys)


def ablation(primary: DataFrame, block: DataFrame, other: DataFrame, keys: list[str], width: int, debounce: int) -> DataFrame:
    """The eight variants of the ensemble as one alarm table (keys, variant, position)."""
    full = and_gate(primary, block, keys, [width], debounce).drop("W")
    bare = and_gate(primary, block, keys, [width], 0).drop("W")
    either = or_gate(primary, other, keys)
    # Names of the variants as they stand in the output.
    variants = {
        "confirmed": full, "suspected": either, "confirmed_no_debounce": bare, "and_only": full, "or_only": either,
        "adwin_standalone": primary, "ph_standalone": block, "kalman_standalone": other}
    out = None
    for name, df in variants.items():
        part = df.select(*keys, F.lit(name).alias("cfg"), "idx").distinct()
        out = part if out is None else out.unionByName(part)
    return out


#: Fixed values, as above.
VARIANTS = ["confirmed", "suspected", "confirmed_no_debounce", "and_only", "or_only",
            "adwin_standalone", "ph_standalone", "kalman_standalone"]


