"""Play segments, gap filling, smoothing, windows and the error table."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import scalars
from tidemark.operators.detectors import kernels
from tidemark.operators.detectors.linked import detect
from tidemark.operators.joins import history
from tidemark.operators.ordered import framed, map_chunks, running, series
from tidemark.operators.smoothers import sliding_windows

# fixed values: referee commands that start play, and the frame rate
START_COMMANDS = [2, 3]
FRAME_RATE = 60.0
SHORTEST_STEP = 0.01
LONGEST_STEP = 0.022
FADED = 1e-14


def play_segments(detections: DataFrame, commands: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Detections during play, with the number of the segment.

    A command 2 or 3 opens play; the next other command closes it.  Commands are
    few: their state changes are found first (a closing command counts only
    after an opening one), then one pass counts openings and closings in front
    of every detection.
    """
    c = series(commands.select(*keys, time, F.col(tie).alias("_tie"), "command"), keys, [time, "_tie"], "_at")
    is_open = F.col("command").isin(START_COMMANDS)
    states = framed(c.using(c.df.withColumn("_open", is_open.cast("int"))),
                    lambda w: {"_was": F.coalesce(F.lag("_open").over(w), F.lit(0))}, 1)
    change = states.where(F.col("_open") != F.col("_was"))
    axis = detections.select(*keys, F.col(time), F.col(tie).alias("_tie"), F.lit(1).alias("_turn"),
                             F.struct(*detections.columns).alias("_d"), F.lit(0).alias("_up"), F.lit(0).alias("_down"))
    marks = change.select(
        *keys, time, "_tie", F.lit(0).alias("_turn"),
        F.lit(None).cast(axis.schema["_d"].dataType).alias("_d"),
        F.col("_open").alias("_up"), (1 - F.col("_open")).alias("_down"))
    cum = running(axis.unionByName(marks), keys, [time, "_turn", "_tie"], {"_ups": F.col("_up"), "_downs": F.col("_down")})
    inside = cum.where((F.col("_turn") == 1) & (F.col("_ups") > F.col("_downs")))
    return inside.select("_d.*", F.col("_downs").cast("bigint").alias("stop_id"))


def one_per_frame(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First detection of each robot in a frame, by its place in the frame."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_r")).select(
        *keys, "_r.*")


class Spacing:
    """Fires on rows more than ``step`` after the last row that fired."""

    settles = True

    @staticmethod
    def reach(p: dict) -> int:
        return int(p.get("warm", 256))

    @staticmethod
    def cold(p: dict) -> list[float]:
        return [-1e300]

    @staticmethod
    def run(p, state, pre, x, lead):
        last, step = float(state[0]), float(p["step"])
        # a row that far from its neighbour is kept whatever happened before
        clear = np.diff(np.concatenate([[last], x])) > step
        if clear.all():
            return np.arange(len(x)), [float(x[-1]) if len(x) else last]
        fired = []
        for i in range(len(x)):
            if clear[i] or x[i] - last > step:
                fired.append(i)
                last = float(x[i])
        return np.asarray(fired, dtype=np.int64), [last]


kernels.register("spacing", Spacing)


def drop_bursts(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Rows more than 0.01 s after the last row that was kept.

    Rows are ordered by time and then by all other columns, so rows of one time stamp are decided
    alike whatever the length of a run.  A row that far from its direct predecessor is kept
    whatever happened before; the chunk kernel decides the rest.
    """
    rest = [c for c in df.columns if c not in [*keys, time]]
    s = series(df, keys, [time, *rest], "_n")
    kept = detect(s, time, [{"cfg": "kept", "detector": "spacing", "step": SHORTEST_STEP}])
    return s.df.join(kept.drop("cfg"), [*keys, "_n"], "left_semi").drop("_n")


def fill_gaps(df: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Rows at the frame rate inside gaps, with the last values and mask false.

    A gap of at least 0.022 s gets as many rows as fit while the rest stays at
    least 0.01 s longer than a frame.
    """
    # stored, because the length of the longest key and the rows are two jobs
    kept = session.cut(drop_bursts(df.select(*keys, time, *values), keys, time))
    s = series(kept, keys, [time], "_n")
    nxt = framed(s, lambda w: {"_next": F.lead(time).over(w)}, 0, 1)
    gap = F.col("_next") - F.col(time)
    wanted = F.when(gap >= LONGEST_STEP, F.greatest(F.floor(FRAME_RATE * gap - 0.6), F.lit(0))).otherwise(0).cast("int")
    slot = F.explode(F.sequence(F.lit(0), F.coalesce(wanted, F.lit(0)))).alias("_k")
    return nxt.select(*keys, time, *values, slot).select(
        *keys, (F.col(time) + F.col("_k") / FRAME_RATE).alias(time), *values, (F.col("_k") == 0).alias("mask"))


def smooth_positions(seen: np.ndarray, mask: np.ndarray, process: float, sensor: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and speeds of the constant-velocity model that fit best.

    The least-squares problem over all states is a chain of 2x2 blocks; one pass
    forward eliminates them and one pass back substitutes.  Columns of ``seen``
    are coordinates that share the model.  Masked rows carry no measurement.
    """
    n = len(seen)
    step = np.array([[1.0, 1.0], [0.0, 1.0]])
    q = process ** 2
    after, before, cross = q * np.eye(2), q * (step.T @ step), -q * step.T
    tiny = 1e-20 * np.eye(2)
    diag = np.empty((n, 2, 2))
    rhs = np.zeros((n, 2, seen.shape[1]))
    for t in range(n):
        block = tiny.copy()
        if t:
            block += after
        if t < n - 1:
            block += before
        if mask[t]:
            block[0, 0] += sensor ** 2
            rhs[t, 0] = sensor ** 2 * seen[t]
        if t:
            lead = cross.T @ np.linalg.inv(diag[t - 1])
            block -= lead @ cross
            rhs[t] -= lead @ rhs[t - 1]
        diag[t] = block
    out = np.empty_like(rhs)
    out[n - 1] = np.linalg.solve(diag[n - 1], rhs[n - 1])
    for t in range(n - 2, -1, -1):
        out[t] = np.linalg.solve(diag[t], rhs[t] - cross @ out[t + 1])
    return out[:, 0, :], out[:, 1, :]


def fading_rows(process: float, sensor: float, faded: float = FADED) -> int:
    """Measured rows after which a measurement has lost its influence, from the settled elimination."""
    step, q = np.array([[1.0, 1.0], [0.0, 1.0]]), process ** 2
    own, cross = q * np.eye(2) + q * (step.T @ step) + np.diag([sensor ** 2, 0.0]), -q * step.T
    block = own
    for _ in range(100_000):
        settled = own - cross.T @ np.linalg.inv(block) @ cross
        if np.allclose(settled, block, rtol=1e-13, atol=0):
            break
        block = settled
    rate = float(np.abs(np.linalg.eigvals(np.linalg.inv(block) @ cross)).max())
    return 50 + math.ceil(math.log(faded) / math.log(min(rate, 1 - 1e-6)))


def smooth_tracks(
    df: DataFrame, keys: list[str], time: str, process: float = 1.0, sensor: float = 1.0,
    shortest: int = 101, heading: bool = True,
) -> DataFrame:
    """Smoothed x, y, vx, vy (and heading) of each track longer than ``shortest``.

    The influence of a measurement fades geometrically with the measured rows between, at a
    rate that the noise terms give, and not at all across rows without a measurement. Long tracks are
    smoothed in chunks whose margins hold enough rows for that beside the longest stretch without one,
    at an end of a track too.
    """
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len")).where(F.col("_len") > shortest)
    s = series(df.join(long.select(*keys), keys, "left_semi"), keys, [time], "idx")

    seen = series(s.df.where("mask").select(*keys, "idx"), keys, ["idx"], "_m")
    hidden = framed(seen, lambda w: {"_gap": F.col("idx") - F.lag("idx", 1, -1).over(w)}, 1).agg(F.max("_gap")).first()[0]
    last = s.df.groupBy(*keys).agg((F.max("idx") - F.max(F.when(F.col("mask"), F.col("idx")))).alias("_tail")).agg(F.max("_tail")).first()[0]
    reach = fading_rows(process, sensor) + 2 * max(int(hidden or s.longest), int(last or 0))

    def kernel(pdf: pd.DataFrame, starts: bool, stops: bool) -> pd.DataFrame:
        if not pdf["_own"].any():  # a margin beyond the end of the track; its rows are dropped
            return pdf.assign(**dict.fromkeys(["sx", "sy", "vx", "vy", *(["spsi"] if heading else [])], 0.0))
        mask = pdf["mask"].to_numpy()
        p, v = smooth_positions(pdf[["x", "y"]].to_numpy(dtype=float), mask, process, sensor)
        out = pdf.assign(sx=p[:, 0], sy=p[:, 1], vx=v[:, 0], vy=v[:, 1])
        if heading:
            psi = pdf["psi"].to_numpy(dtype=float)
            c, _ = smooth_positions(np.column_stack([np.sin(psi), np.cos(psi)]), mask, process, sensor)
            out["spsi"] = np.arctan2(c[:, 0], c[:, 1])
        return out

    cols = [time, "x", "y", "mask", *(["psi"] if heading else [])]
    added = "sx double, sy double, vx double, vy double" + (", spsi double" if heading else "")
    return map_chunks(s, cols, kernel, added, reach, reach)


def kinematics(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Speed, acceleration and wrapped turn of every row (the first has no change)."""
    s = series(df, keys, [order], "_n")
    heading = F.atan2("vy", "vx")
    cols = s.using(s.df.withColumn("speed", F.hypot("vx", "vy")).withColumn("_h", heading))
    out = framed(cols, lambda w: {
        "accel": F.hypot(F.col("vx") - F.lag("vx").over(w), F.col("vy") - F.lag("vy").over(w)),
        "turn": F.abs(scalars.wrap_angle(F.col("_h") - F.lag("_h").over(w)))}, 1)
    return out.drop("_h", "_n")


def forecast_windows(
    df: DataFrame, keys: list[str], order: list[str], back: int, forth: int, slowest: float = 5.0,
    carry: list[str] | None = None,
) -> DataFrame:
    """Look-back / look-forth windows whose future moves at all, numbered per key."""
    s = series(df, keys, order, "start")
    w = sliding_windows(s, back, forth, ["x", "y", "vx", "vy"], carry)
    moving = scalars.array_mean(scalars.norms(F.col("future_vx"), F.col("future_vy"))) >= slowest
    return w.where(moving)


def with_ball(windows: DataFrame, balls: DataFrame, keys: list[str], time: str, ask_id: str, tie: str, depth: int) -> DataFrame:
    """Ball rows seen before each window; windows without a ball keep empty slots."""
    h = history(windows, balls, keys, time, ask_id, tie, ["x", "y"], depth)
    h = h.select(*keys, ask_id, F.col("x").alias("ball_x"), F.col("y").alias("ball_y"), F.col("mask").alias("ball_mask"))
    return windows.join(h, [*keys, ask_id], "left")


def targets(windows: DataFrame, stats: dict[str, float], kind: str = "dv") -> DataFrame:
    """Scaled targets: speed increments from the last seen speed, or speeds."""
    out = windows
    for a in ("x", "y"):
        v, last = F.col(f"future_v{a}"), F.element_at(f"past_v{a}", -1)
        if kind == "dv":
            full = F.concat(F.array(last), v)
            t = F.transform(scalars.array_diff(full), lambda d: d / stats[f"v{a}_std"])
        else:
            t = F.transform(v, lambda u: (u - stats[f"v{a}_avg"]) / stats[f"v{a}_std"])
        out = out.withColumn(f"target_{a}", t)
    return out


def positions_from_targets(start: F.Column, v0: F.Column, target: F.Column, std: float, avg: float, kind: str) -> F.Column:
    """Positions that scaled targets stand for."""
    real = F.transform(target, lambda d: d * std + (0.0 if kind == "dv" else avg))
    v = scalars.array_cumsum(real, v0) if kind == "dv" else real
    return scalars.array_cumsum(v, start)


def error_rows(windows: DataFrame, forth: int, ids: list[str], model: str, horizon: str) -> DataFrame:
    """ADE and FDE of the constant-velocity forecast of each window."""
    past = lambda c: F.element_at(f"past_{c}", -1)
    px = scalars.constant_velocity(past("x"), past("vx"), forth)
    py = scalars.constant_velocity(past("y"), past("vy"), forth)
    m = scalars.displacement(px, py, F.col("future_x"), F.col("future_y"))
    return windows.select(
        *ids, F.lit(model).alias("model"), F.lit(horizon).alias("horizon"),
        m["ade"].alias("ade_traj"), m["fde"].alias("fde_traj"), F.lit(forth).alias("n_steps_pred"))


def errors_of_forecasts(windows: DataFrame, forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """ADE and FDE of any forecast table (keys, model, horizon, pred_x, pred_y)."""
    j = windows.select(*keys, "future_x", "future_y").join(forecasts, keys)
    m = scalars.displacement(F.col("pred_x"), F.col("pred_y"), F.col("future_x"), F.col("future_y"))
    return j.select(*keys, "model", "horizon", m["ade"].alias("ade_traj"), m["fde"].alias("fde_traj"),
                    F.size("pred_x").alias("n_steps_pred"))


def regime_parts(units: DataFrame, group: str, period: str, breaks: DataFrame, least: int = 2) -> DataFrame:
    """Units before and after each break period; too few on a side marks it unusable."""
    b = breaks.select(F.col(period).alias("_break")).distinct()
    held = b.agg(F.collect_list("_break")).scalar()
    sides = units.select(group, period).distinct().withColumn("break_year", F.explode(held)).withColumn(
        "side", F.when(F.col(period) < F.col("break_year"), "before").otherwise("after"))
    w = Window.partitionBy("break_year", "side")
    ok = F.min("_m").over(Window.partitionBy("break_year")) >= least
    both = F.size(F.collect_set("side").over(Window.partitionBy("break_year"))) == 2
    return sides.withColumn("_m", F.count(F.lit(1)).over(w)).withColumn("usable", ok & both).drop("_m")
