"""Track preparation on small hand-made inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import tracks


def plain_fill(times):
    """(time, real) rows of one robot, by the rule of the frame rate."""
    out = [(times[0], True)]
    for t in times[1:]:
        gap = t - out[-1][0]
        if 0.01 < gap < 0.022:
            out.append((t, True))
        elif gap >= 0.022:
            for _ in range(math.floor(gap * 60)):
                if t - out[-1][0] - 1 / 60 < 0.01:
                    break
                out.append((out[-1][0] + 1 / 60, False))
            out.append((t, True))
    return out


def test_gap_fill(spark):
    rng = np.random.default_rng(0)
    gaps = np.r_[0.009, 0.015, 0.022, 0.5, 0.004, 0.004, 0.004, 0.015, rng.uniform(0.003, 0.08, 60)]
    t = 5.0 + np.r_[0.0, np.cumsum(gaps)]
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "t": t, "x": np.arange(len(t), dtype=float)}))
    got = sorted((r["t"], r["mask"]) for r in tracks.fill_gaps(df, ["k"], "t", ["x"]).collect())
    want = plain_fill(t.tolist())
    assert [m for _, m in got] == [m for _, m in want]
    np.testing.assert_allclose([a for a, _ in got], [a for a, _ in want], atol=1e-9)


def test_ties_do_not_depend_on_chunks(spark):
    rows = [("a", i // 3 / 50, float(x)) for i, x in enumerate(np.random.default_rng(1).permutation(1500))]
    df = spark.createDataFrame(rows, "k string, t double, x double").repartition(5)
    whole = tracks.drop_bursts(df, ["k"], "t").agg({"x": "sum", "t": "count"}).first()
    spark.conf.set("spark.tidemark.chunkRows", "300")
    spark.conf.set("spark.tidemark.groupRows", "200")
    try:
        split = tracks.drop_bursts(df, ["k"], "t").agg({"x": "sum", "t": "count"}).first()
    finally:
        spark.conf.unset("spark.tidemark.chunkRows")
        spark.conf.unset("spark.tidemark.groupRows")
    least = sum(min(rows[i + j][2] for j in range(3)) for i in range(0, 1500, 3))
    assert whole == split and whole["sum(x)"] == least and whole["count(t)"] == 500


def test_segments_follow_commands(spark):
    cmd = spark.createDataFrame([("g", 1.0, 0, 9), ("g", 2.0, 1, 2), ("g", 3.0, 2, 3), ("g", 5.0, 3, 0), ("g", 6.0, 4, 1), ("g", 7.0, 5, 3)],
                                "k string, t double, i bigint, command int")
    det = spark.createDataFrame([("g", t, i) for i, t in enumerate([0.5, 1.5, 2.5, 4.5, 5.5, 6.5, 7.5])], "k string, t double, i bigint")
    got = sorted((r["t"], r["stop_id"]) for r in tracks.play_segments(det, cmd, ["k"], "t", "i").collect())
    # play opens at 2 and again at 7; the repeated opening and closing change nothing
    assert got == [(2.5, 0), (4.5, 0), (7.5, 1)]


def test_first_detection_of_a_frame_wins(spark):
    df = spark.createDataFrame([(1, 7, 1, 5.0), (1, 7, 0, 4.0), (2, 7, 0, 6.0)], "frame int, robot int, place int, x double")
    got = {r["frame"]: r["x"] for r in tracks.one_per_frame(df, ["frame", "robot"], ["place"]).collect()}
    assert got == {1: 4.0, 2: 6.0}


def dense_smoother(seen, mask, process, sensor):
    n = len(seen)
    a = np.zeros((2 * (n - 1), 2 * n))
    step = np.array([[1.0, 1.0], [0.0, 1.0]])
    for t in range(n - 1):
        a[2 * t:2 * t + 2, 2 * t + 2:2 * t + 4] = process * np.eye(2)
        a[2 * t:2 * t + 2, 2 * t:2 * t + 2] = -process * step
    rows = [np.eye(2 * n)[2 * t] * sensor for t in range(n) if mask[t]]
    full = np.vstack([a, rows, 1e-10 * np.eye(2 * n)])
    rhs = np.zeros((len(full), seen.shape[1]))
    rhs[len(a):len(a) + len(rows)] = sensor * seen[mask]
    z = np.linalg.lstsq(full, rhs, rcond=None)[0]
    return z[0::2], z[1::2]


def test_position_smoother_is_the_least_squares_path():
    rng = np.random.default_rng(1)
    seen, mask = rng.normal(size=(30, 2)).cumsum(axis=0), rng.random(30) > 0.3
    mask[:2] = True
    p, v = tracks.smooth_positions(seen, mask, 1.3, 0.6)
    wp, wv = dense_smoother(seen, mask, 1.3, 0.6)
    np.testing.assert_allclose(p, wp, atol=1e-5)
    np.testing.assert_allclose(v, wv, atol=1e-5)


def test_long_tracks_are_smoothed_in_chunks(small_chunks):
    n = 900
    rng = np.random.default_rng(2)
    xy = rng.normal(size=(n, 2)).cumsum(axis=0)
    pdf = pd.DataFrame({"k": "a", "t": np.arange(n) / 60, "x": xy[:, 0], "y": xy[:, 1], "psi": rng.uniform(-3, 3, n), "mask": rng.random(n) > 0.2})
    pdf.loc[200:520, "mask"] = False  # a stretch longer than a chunk
    got = tracks.smooth_tracks(small_chunks.createDataFrame(pdf), ["k"], "t", sensor=0.7).toPandas().sort_values("idx")
    p, v = tracks.smooth_positions(xy, pdf["mask"].to_numpy(), 1.0, 0.7)
    np.testing.assert_allclose(got[["sx", "sy"]], p, atol=1e-6)
    np.testing.assert_allclose(got[["vx", "vy"]], v, atol=1e-6)


def test_a_long_tail_without_measurements_goes_on_as_one_pass(spark, small_chunks):
    n = 1500
    xy = np.random.default_rng(3).normal(size=(n, 2)).cumsum(axis=0) + 500
    pdf = pd.DataFrame({"k": "a", "t": np.arange(n) / 60, "x": xy[:, 0], "y": xy[:, 1], "psi": 0.5, "mask": np.arange(n) < 400})
    p, _ = tracks.smooth_positions(xy, pdf["mask"].to_numpy(), 1.0, 0.7)
    for rows in ("300", "100000"):
        spark.conf.set("spark.tidemark.chunkRows", rows)
        got = tracks.smooth_tracks(spark.createDataFrame(pdf), ["k"], "t", sensor=0.7).toPandas().sort_values("idx")
        np.testing.assert_allclose(got[["sx", "sy"]], p, rtol=1e-4)


def test_short_tracks_are_left_out(spark):
    pdf = pd.DataFrame({"k": ["a"] * 5, "t": np.arange(5.0), "x": 1.0, "y": 1.0, "psi": 0.0, "mask": True})
    assert tracks.smooth_tracks(spark.createDataFrame(pdf), ["k"], "t").count() == 0


def test_targets_integrate_back_to_positions(spark):
    n = 14
    pdf = pd.DataFrame({"k": "a", "o": range(n), "x": np.cumsum(np.arange(n) * 1.5), "y": np.cumsum(np.ones(n) * 7)})
    pdf["vx"], pdf["vy"] = pdf["x"].diff().fillna(9.0), pdf["y"].diff().fillna(9.0)
    stats = {"vx_std": 3.0, "vy_std": 2.0, "vx_avg": 1.0, "vy_avg": 0.5}
    w = tracks.forecast_windows(spark.createDataFrame(pdf), ["k"], ["o"], 4, 3)
    for kind in ("dv", "v"):
        t = tracks.targets(w, stats, kind)
        pos = tracks.positions_from_targets(F.element_at("past_x", -1), F.element_at("past_vx", -1), F.col("target_x"), 3.0, 1.0, kind)
        for r in t.select(pos.alias("p"), "future_x").collect():
            np.testing.assert_allclose(r["p"], r["future_x"])
    assert w.count() == n - 7  # one fewer than fits


def test_slow_windows_are_skipped(spark):
    pdf = pd.DataFrame({"k": "a", "o": range(12), "x": 0.0, "y": 0.0, "vx": 3.0, "vy": 3.9})
    assert tracks.forecast_windows(spark.createDataFrame(pdf), ["k"], ["o"], 4, 3).count() == 0


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 4.0, 2.0],), ([],), ([5.0],)], "a array<double>")
    a = F.col("a")
    r = df.select(scalars.array_diff(a), scalars.array_quantile(a, 0.5), scalars.array_mean(a), scalars.array_cumsum(a)).collect()
    assert tuple(r[0]) == ([3.0, -2.0], 2.0, pytest.approx(7 / 3), [1.0, 5.0, 7.0])
    assert tuple(r[1]) == ([], None, None, [])
    assert tuple(r[2]) == ([], 5.0, 5.0, [5.0])


def test_angles_wrap(spark):
    x = [-7.0, -math.pi, 0.0, 3.0, 4.0, 10.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "d double").select(scalars.wrap_angle("d")).collect()]
    np.testing.assert_allclose(got, [(v + math.pi) % (2 * math.pi) - math.pi for v in x])


def test_gap_fill_shares_tasks_between_tracks(spark):
    """Many short tracks, also without a key, come as one stream: no call a track, whatever the size of a batch."""
    rng = np.random.default_rng(1)
    parts = {k: 5.0 + np.cumsum(rng.uniform(0.003, 0.05, 3 + k % 40)) for k in range(60)}
    rows = [(None if k == 7 else k, f"g{k % 2}", float(t), float(i)) for k, ts in parts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k long, g string, t double, x double")
    plan = detect_plan(tracks.drop_bursts(df, ["k", "g"], "t"))
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {}
            for r in tracks.fill_gaps(df, ["k", "g"], "t", ["x"]).collect():
                got.setdefault(r["k"], []).append((r["t"], r["mask"]))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(got) == [k for k in parts if k != 7]
        for k, seen in got.items():
            want = plain_fill(parts[k].tolist())
            assert [m for _, m in sorted(seen)] == [m for _, m in want]
            np.testing.assert_allclose([t for t, _ in sorted(seen)], [t for t, _ in want], atol=1e-9)


def detect_plan(df):
    return df._jdf.queryExecution().toString()


def test_windows_and_features_read_stored_rows(spark, sf):
    """Detections are parsed once for all jobs of the windows, and the windows formed once for all readers of the features."""
    from tidemark.plans.detector_queries import window_errors
    from tidemark.plans.shift_queries import feature_vectors, windows

    w = windows(spark, sf)
    assert "get_json_object" not in detect_plan(w)
    assert "collect_list" not in detect_plan(feature_vectors(spark, sf, w))
    assert "collect_list" not in detect_plan(window_errors(spark, sf))
