"""Chunked detectors against plain one-row-at-a-time loops."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import smoothing
from tidemark.operators import ordered
from tidemark.operators.detectors import kernels
from tidemark.operators.detectors.linked import detect


def drifting(seed=0, n=4000):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, n)
    x[n // 3:] += 0.8
    x[2 * n // 3:] *= 1.4
    return x


def plain_split(x, delta, max_window, min_window, cooldown):
    limit = max(2.0, math.sqrt(2 * math.log(2 / delta)))
    held, quiet, out = [], 0, []
    for i, v in enumerate(x):
        held.append(v)
        held = held[-max_window:]
        if quiet:
            quiet -= 1
            continue
        if len(held) < min_window:
            continue
        a, b = np.array(held[:len(held) // 2]), np.array(held[len(held) // 2:])
        sd = math.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b))
        if sd >= 1e-9 and abs(a.mean() - b.mean()) / sd > limit:
            out.append(i)
            held, quiet = list(b), cooldown
    return out


def plain_hinkley(x, delta, threshold, min_instances, cooldown):
    mean = total = low = 0.0
    quiet, out = 0, []
    for i, v in enumerate(x):
        mean += (v - mean) / (i + 1)
        total += v - mean - delta
        low = min(low, total)
        if quiet:
            quiet -= 1
        elif i + 1 >= min_instances and total - low > threshold:
            out.append(i)
            total = low = 0.0
            quiet = cooldown
    return out


def plain_recent(x, alpha, ref, new):
    step = kernels.ks_critical_step(alpha, ref, new)
    unit = ref * new // math.gcd(ref, new)
    held, since, out = [], 0, []
    for i, v in enumerate(x):
        held = (held + [v])[-(ref + new):]
        since += 1
        if since < new or len(held) < ref + new:
            continue
        since = 0
        if round(kernels.ks_distance(np.array(held[:ref]), np.array(held[-new:])) * unit) >= step:
            out.append(i)
            held = held[-new:]
    return out


SPLIT = dict(delta=1e-3, max_window=150, min_window=40, cooldown=30)
HINKLEY = dict(delta=0.1, threshold=12.0, min_instances=50, cooldown=40)
RECENT = dict(alpha=1e-3, window_size=100, stat_size=50)
BUCKET = dict(delta=0.01, max_window=400, min_window=40, cooldown=30)


def spread(spark, columns):
    frames = [pd.DataFrame({"k": k, "o": np.arange(len(v)), "value": v}) for k, v in columns.items()]
    pdf = pd.concat(frames).sample(frac=1.0, random_state=1)
    return ordered.series(spark.createDataFrame(pdf).repartition(5), ["k"], ["o"])


def by_cfg(rows):
    out = {}
    for r in rows:
        out.setdefault((r["k"], r["cfg"]), []).append(r["idx"])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("rows", [10_000, 300])
def test_alarms_equal_a_single_pass(spark, small_chunks, rows):
    data = {"a": drifting(1), "b": drifting(2, 1500), "c": np.full(500, 3.0)}
    s = spread(spark, data)
    configs = [
        {"cfg": "split", "detector": "mean_split", **SPLIT},
        {"cfg": "hinkley", "detector": "page_hinkley", "warm": 200, **HINKLEY},
        {"cfg": "recent", "detector": "recent_sample", **RECENT},
        {"cfg": "split_z", "detector": "mean_split", "smoother": ("robz", {"w": 20}), **SPLIT},
        {"cfg": "hinkley_e", "detector": "page_hinkley", "warm": 200,
         "smoother": ("ewma", {"alpha": 0.3}), **HINKLEY},
    ]
    got = by_cfg(detect(s, "value", configs, rows=rows).collect())
    want = {}
    for k, x in data.items():
        want[(k, "split")] = plain_split(x, **SPLIT)
        want[(k, "hinkley")] = plain_hinkley(x, **HINKLEY)
        want[(k, "recent")] = plain_recent(x, 1e-3, 100, 50)
        want[(k, "split_z")] = plain_split(smoothing.robust_z(x, 20), **SPLIT)
        want[(k, "hinkley_e")] = plain_hinkley(smoothing.exponential(x, 0.3), **HINKLEY)
    want = {k: v for k, v in want.items() if v}
    assert got == want
    assert {cfg for _, cfg in got} >= {"split", "hinkley", "recent", "hinkley_e"}


def test_histogram_window_is_the_same_in_chunks(spark, small_chunks):
    data = {"a": drifting(5, 3000)}
    s = spread(spark, data)
    configs = [{"cfg": "bucket", "detector": "bucket_window", **BUCKET}]
    whole = by_cfg(detect(s, "value", configs, rows=10_000).collect())
    parts = by_cfg(detect(s, "value", configs, rows=700).collect())
    assert whole and whole == parts


def test_histogram_totals_match_the_rows_kept():
    w = kernels._Histogram(BUCKET, [0.0])
    x = drifting(3, 350)
    for v in x:
        w.add(v)
    assert w.width == 350
    assert w.total == pytest.approx(x.sum())
    assert w.spread == pytest.approx(((x - x.mean()) ** 2).sum())
    again = kernels._Histogram(BUCKET, w.dump())
    assert again.dump() == w.dump()


def test_rows_that_are_not_finite_are_passed_over(spark):
    x = drifting(4, 1200)
    holes = x.copy()
    holes[::7] = np.nan
    holes[5] = np.inf
    s = spread(spark, {"a": holes})
    got = by_cfg(detect(s, "value", [{"cfg": "s", "detector": "mean_split", **SPLIT}]).collect())
    at = np.flatnonzero(np.isfinite(holes))
    assert got[("a", "s")] == [int(at[i]) for i in plain_split(holes[at], **SPLIT)]


def test_critical_distance_is_the_first_below_alpha():
    # n = m = 3: only full separation (2 of the 20 orders) has p = 0.1
    assert kernels.ks_critical_step(0.11, 3, 3) == 3
    # n = m = 4: distance 1 has p = 2/70, distance 3/4 has p = 16/70
    assert kernels.ks_critical_step(0.03, 4, 4) == 4
    assert kernels.ks_critical_step(0.23, 4, 4) == 3


def test_two_sided_reacts_to_a_fall():
    x = np.r_[np.zeros(40), np.full(40, -3.0)]
    hits, _ = kernels.TwoSidedHinkley.run(
        {"threshold": 5.0, "min_instances": 3}, kernels.TwoSidedHinkley.cold({}), x[:0], x, (0, 0))
    assert len(hits) and 40 <= hits[0] < 46


def test_walked_chunks_cost_no_further_jobs(spark):
    """The all-cuts window over 3 and over 30 chunks: equal alarms, equally many jobs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000) + (np.arange(3000) // 700) % 2
    pdf = pd.DataFrame({"k": np.where(np.arange(3000) % 5 == 0, "a", "b"), "o": np.arange(3000), "v": x})
    s = ordered.series(spark.createDataFrame(pdf), ["k"], ["o"])
    configs = [{"cfg": f"b{d}{sm}", "detector": "bucket_window", "delta": d, "max_window": 600, "min_window": 40, "cooldown": 20,
                **({"smoother": ("robz", {"w": 20})} if sm else {})} for d in (0.3, 0.01) for sm in (False, True)]
    configs.append({"cfg": "s", "detector": "mean_split", "delta": 0.05, "max_window": 200, "min_window": 40, "cooldown": 20})
    answers, jobs = [], []
    for rows in (5000, 800, 80):
        spark.sparkContext.setJobGroup(f"walk{rows}", "walk")
        answers.append(sorted(tuple(r) for r in detect(s, "v", configs[:4], rows=rows).collect()))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walk{rows}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert answers[0] == answers[1] == answers[2] and answers[0]
    assert jobs[1] == jobs[2]
    mixed = sorted(tuple(r) for r in detect(s, "v", configs, rows=300).collect())
    assert mixed == sorted(tuple(r) for r in detect(s, "v", configs, rows=5000).collect())


@pytest.mark.parametrize("numbers", [
    {"delta": 0.2, "min_window": 60, "max_window": 400, "cooldown": 40}, {"delta": 0.3, "min_window": 1, "max_window": 90, "cooldown": 0}])
def test_two_halves_look_at_few_rows_after_an_alarm(monkeypatch, numbers):
    """Alarms in close order cost some rows each, and are those of one long look."""
    rng = np.random.default_rng(4)
    x = pd.Series(rng.normal(size=4000)).rolling(40, min_periods=1).mean().to_numpy()
    tested = []
    looks = kernels._looks
    monkeypatch.setattr(kernels, "_looks", lambda *a: (tested.append(b - a) or (a, b) for a, b in looks(*a)))
    hits, state = kernels.MeanSplit.run(numbers, [0.0, 0.0], x[:0], x, (0.0, 0.0))
    assert len(hits) > 40 and sum(tested) < 3 * len(x)
    monkeypatch.setattr(kernels, "SINGLE_ROWS", 0)
    monkeypatch.setattr(kernels, "_looks", lambda start, end, *size: looks(start, end))
    whole, end = kernels.MeanSplit.run(numbers, [0.0, 0.0], x[:0], x, (0.0, 0.0))
    assert hits.tolist() == whole.tolist() and state == end
