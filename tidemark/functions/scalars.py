"""Scalar expressions: clipping, angles, names, calibration, array features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: caps of the robust clip, per feature
ROBUST_CAPS = {"speed": 8000.0, "accel": 500.0}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    out = col(c)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return out


def robust_clip(feature: Column, value: Column) -> Column:
    """Cap by feature name; features without a cap pass through."""
    out = F.when(F.lit(False), value)
    for name, cap in ROBUST_CAPS.items():
        out = out.when(feature == name, F.least(value, F.lit(cap)))
    return out.otherwise(value)


def wrap_angle(c: Column | str) -> Column:
    """Angle brought into [-pi, pi)."""
    return F.pmod(col(c) + math.pi, F.lit(2 * math.pi)) - math.pi


def ratio_pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def first_year(c: Column | str) -> Column:
    """The first 19xx or 20xx in a text, NULL when there is none."""
    found = F.regexp_extract(col(c), r"((?:19|20)\d{2})", 1)
    return found.try_cast("int")


def first_number(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"(\d+)", 1).try_cast("bigint")


def strip_suffix(c: Column | str, suffix: str) -> Column:
    return F.regexp_replace(col(c), f"{suffix.replace('.', chr(92) + '.')}$", "")


# fixed values: what match names leave out of log names
STAMP = r"^\d{4}-\d{2}-\d{2}_\d{2}-\d{2}_"
ODD = r"[^A-Za-z0-9_-]+"


def match_name(year: Column, teams: Column, log_file: Column, fallback: Column) -> Column:
    """The year and the most telling name there is: both teams, the log without path, ending and time
    stamp, or the file of the track set. Nothing is cut off, so different logs keep different names."""
    given = lambda c: F.when(F.length(c) > 0, c)
    log = F.replace(F.element_at(F.split(given(log_file), "/"), -1), F.lit(".log"), F.lit(""))
    pair = F.translate(F.replace(given(teams), F.lit(" vs "), F.lit("_vs_")), " -", "")
    named = F.coalesce(
        F.regexp_replace(pair, ODD, ""), F.regexp_replace(F.regexp_replace(log, STAMP, ""), ODD, "_"),
        F.replace(fallback, F.lit(".pkl"), F.lit("")))
    return F.concat_ws("_", year.cast("string"), named)


def division_of(log_file: Column) -> Column:
    """Division named inside a log file name, NULL when it names none."""
    text = F.upper(log_file)
    return F.when(text.rlike(r"DIV[_ -]?A"), "A").when(text.rlike(r"DIV[_ -]?B"), "B")


def config_text(delta: Column, min_window: Column, cooldown: Column, max_window: Column) -> Column:
    return F.concat_ws(
        ", ", F.concat(F.lit("delta="), delta.cast("string")), F.concat(F.lit("mw="), min_window.cast("string")),
        F.concat(F.lit("cd="), cooldown.cast("string")), F.concat(F.lit("xw="), max_window.cast("string")))


def config_value(text: Column, name: str) -> Column:
    """One number of a ``name=value`` list."""
    return F.regexp_extract(text, rf"\b{name}=([0-9.eE+-]+)", 1).try_cast("double")


def regime(ess: Column, stable: float = 0.5, marginal: float = 0.3) -> Column:
    return F.when(ess >= stable, "stable").when(ess >= marginal, "marginal").otherwise("unstable")


def recovery_columns(mean: Column, iw: Column, base: Column) -> dict[str, Column]:
    """Excess, raw and clipped recovered share and the note that goes with it."""
    excess = mean - base
    raw = F.when(excess > 1e-6, (mean - iw) / excess * 100)
    # Names and notes as they stand in the output.
    return {
        "excess_total": excess,
        "recovery_raw": raw,
        "recovery_pct": F.when(raw.isNotNull(), clip(raw, 0.0, 100.0)),
        "overshoot": F.coalesce((raw > 100) | (raw < 0), F.lit(False)),
        "recovery_note": F.when(excess <= 1e-6, "no_excess").when(raw > 100, "overshoot_high")
        .when(raw < 0, "overshoot_low").otherwise("ok"),
    }


def relative_ratio(w: Column | str, alpha: float) -> Column:
    """Weight of the mixture form of a density ratio, bounded by 1/alpha."""
    c = col(w)
    return c / (alpha * c + (1 - alpha))


def adaptive_parameters(n: Column) -> dict[str, Column]:
    """Detector parameters derived from the length of the series."""
    whole = lambda c: F.floor(c).cast("int")
    # Names, factors and limits that the published tables use.
    return {
        "k_thr": clip(5.0 + 5.0 * F.log10(F.greatest(n, F.lit(1)) / 1000.0), 8.0, 50.0),
        "min_instances": whole(clip(n * 0.02, 100.0, 400.0)),
        "cooldown": whole(clip(n * 0.005, 30.0, 100.0)),
        "adwin_delta": F.when(n < 5000, 1e-3).when(n < 50000, 1e-4).otherwise(5e-5),
        "adwin_min_window": whole(clip(n * 0.03, 60.0, 150.0)),
    }


def z_critical(delta: Column | str) -> Column:
    return F.greatest(F.lit(2.0), F.sqrt(2.0 * F.log(2.0 / col(delta))))


def modified_bic(cost: Column, breaks: Column, length: Column) -> Column:
    return cost + (3 * breaks + 1) * F.log(length.cast("double"))


# ---- arrays -----------------------------------------------------------------

def array_mean(a: Column) -> Column:
    return F.try_divide(
        F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a).cast("double"))


def array_quantile(a: Column, p: float) -> Column:
    """Linear quantile of one array; NULL when it is empty."""
    sorted_a = F.array_sort(a)
    at = (F.size(a) - 1) * F.lit(float(p))
    low = F.floor(at).cast("int")
    get = lambda i: F.get(sorted_a, i)
    high = F.least(low + 1, F.size(a) - 1)
    return get(low) + (get(high) - get(low)) * (at - low)


def array_diff(a: Column) -> Column:
    """Differences of neighbours; one element shorter."""
    n = F.size(a)
    tail = F.slice(a, 2, F.greatest(n - 1, F.lit(0)))
    head = F.slice(a, 1, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(tail, head, lambda x, y: x - y)


def array_cumsum(a: Column, start: Column | None = None) -> Column:
    """Running totals of an array, from ``start``."""
    begin = start if start is not None else F.lit(0.0)
    empty = F.array().cast("array<double>")
    return F.aggregate(
        a, F.struct(begin.alias("s"), empty.alias("out")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"] + x)).alias("out")),
        lambda acc: acc["out"])


def norms(ax: Column, ay: Column) -> Column:
    return F.zip_with(ax, ay, lambda x, y: F.hypot(x, y))


def displacement(px: Column, py: Column, tx: Column, ty: Column) -> dict[str, Column]:
    """Average and final distance between predicted and true positions."""
    d = norms(F.zip_with(px, tx, lambda a, b: a - b), F.zip_with(py, ty, lambda a, b: a - b))
    return {"ade": array_mean(d), "fde": F.element_at(d, -1)}


def constant_velocity(p0: Column, v0: Column, k: int) -> Column:
    """Positions for k steps at the last observed velocity."""
    return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: p0 + i * v0)


def transition_forecast(p0: Column, v0: Column, k: int) -> Column:
    """Positions when the state (p, v) advances by the constant-velocity step."""
    state = F.struct(p0.cast("double").alias("p"), v0.cast("double").alias("v"),
                     F.array().cast("array<double>").alias("out"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(k)), state,
        lambda s, _: F.struct(
            (s["p"] + s["v"]).alias("p"), s["v"].alias("v"),
            F.concat(s["out"], F.array(s["p"] + s["v"])).alias("out")),
        lambda s: s["out"])


def kinematic_features(vx: Column, vy: Column, wrapped: bool = False) -> dict[str, Column]:
    """Speed, acceleration and turn summaries of one window, log-scaled."""
    speed = norms(vx, vy)
    accel = norms(array_diff(vx), array_diff(vy))
    heading = F.zip_with(vy, vx, lambda y, x: F.atan2(y, x))
    turn = F.transform(array_diff(heading), lambda d: F.abs(wrap_angle(d) if wrapped else d))
    # the turn array keeps the length of the window: its last value is repeated
    turn = F.concat(turn, F.slice(turn, -1, 1))
    return {"speed": speed, "accel": accel, "turn": turn}


def kinematic_summary(arrays: dict[str, Column]) -> dict[str, Column]:
    s, a, t = arrays["speed"], arrays["accel"], arrays["turn"]
    out = {
        "speed_mean": array_mean(s), "speed_p90": array_quantile(s, 0.90), "speed_p99": array_quantile(s, 0.99),
        "accel_mean": array_mean(a), "accel_p90": array_quantile(a, 0.90), "accel_p99": array_quantile(a, 0.99),
        "turn_mean": array_mean(t), "turn_p90": array_quantile(t, 0.90),
    }
    return {n: F.log1p(c) for n, c in out.items()}


def normalise(c: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(c - mean, std)


def denormalise(c: Column, mean: Column, std: Column) -> Column:
    return c * std + mean


def with_columns(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in cols.items()])
