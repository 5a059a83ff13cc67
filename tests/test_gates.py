"""Gates, nearest partners and alarm metrics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.operators import evaluate, gates, joins, ordered


def alarm_sets(spark, seed=0, n=120, span=4000):
    rng = np.random.default_rng(seed)
    a, b = sorted(rng.choice(span, n, False).tolist()), sorted(rng.choice(span, n, False).tolist())
    frame = lambda x: spark.createDataFrame([("s", int(i)) for i in x], "k string, idx bigint")
    return a, b, frame(a), frame(b)


def plain_gate(a, b, width, pause):
    qa, qb, out, last = [], [], [], -10 ** 12
    for at, src in sorted([(i, 0) for i in a] + [(i, 1) for i in b]):
        qa, qb = [i for i in qa if at - i <= width], [i for i in qb if at - i <= width]
        (qb if src else qa).append(at)
        if qa and qb and at - last > pause:
            out.append(at)
            last, qa, qb = at, [], []
    return out


def plain_nearest(a, b, width, pause):
    out, last = [], -10 ** 12
    for x in a:
        partner = min(b, key=lambda y: (abs(y - x), -y))
        t = max(x, partner)
        if abs(partner - x) <= width and t - last >= pause:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("conf", [None, "small"])
def test_coincidence_gate(spark, request, conf):
    if conf:
        request.getfixturevalue("small_chunks")
        spark.conf.set("spark.tidemark.chunkRows", "40")
    a, b, da, db = alarm_sets(spark)
    got = gates.and_gate(da, db, ["k"], [5, 25, 100], 60).toPandas()
    for w in (5, 25, 100):
        assert sorted(got[got["W"] == w]["idx"]) == plain_gate(a, b, w, 60)


def test_nearest_gate(spark):
    a, b, da, db = alarm_sets(spark, 3)
    got = gates.nearest_gate(da, db, ["k"], [5, 25], 90).toPandas()
    for w in (5, 25):
        assert sorted(got[got["W"] == w]["idx"]) == plain_nearest(a, b, w, 90)


def test_gates_at_the_exact_limits(spark):
    frame = lambda x: spark.createDataFrame([("s", i) for i in x], "k string, idx bigint")
    a, b = frame([100, 300]), frame([110, 310])
    hits = lambda w, d: sorted(r["idx"] for r in gates.and_gate(a, b, ["k"], [w], d).collect())
    assert hits(10, 0) == [110, 310] and hits(9, 0) == []
    assert hits(10, 199) == [110, 310] and hits(10, 200) == [110]  # strictly more than the pause
    near = lambda d: sorted(r["idx"] for r in gates.nearest_gate(a, b, ["k"], [10], d).collect())
    assert near(200) == [110, 310] and near(201) == [110]  # at least the pause


def test_confirmed_alarms_lie_in_the_union(spark):
    a, b, da, db = alarm_sets(spark, 7)
    union = {r["idx"] for r in gates.or_gate(da, db, ["k"]).collect()}
    assert {r["idx"] for r in gates.and_gate(da, db, ["k"], [50], 10).collect()} <= union
    assert union == set(a) | set(b)


def test_two_tier_flags(spark):
    a, b, da, db = alarm_sets(spark, 9)
    t = gates.two_tier(da, db, db.limit(0), ["k"], 20, 50).toPandas()
    assert sorted(t[t["confirmed"]]["idx"]) == plain_gate(a, b, 20, 50)
    assert sorted(t[t["suspected"]]["idx"]) == a and not t["kalman_alarm"].any()


@pytest.mark.parametrize("split", [False, True])
def test_nearest_partner(spark, small_chunks, split):
    if not split:
        spark.conf.set("spark.tidemark.groupRows", "100000")
    a, b, da, db = alarm_sets(spark, 11)
    got = {r["idx"]: (r["partner"], r["gap"]) for r in joins.nearest(da, db, ["k"]).collect()}
    assert got == {x: (p, abs(p - x)) for x in a for p in [min(b, key=lambda y: (abs(y - x), -y))]}
    best = joins.closest_pair(da, db, ["k"]).first()
    assert best["delta_min"] == min(abs(x - y) for x in a for y in b)


def test_band_pairs_and_sums_agree_with_all_pairs(spark):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"l": range(60), "n_l": rng.integers(1, 400, 60)})
    right = pd.DataFrame({"r": range(50), "n_r": rng.integers(1, 400, 50), "v": rng.random(50)})
    want = left.merge(right, how="cross")
    want = want[(want["n_l"] - want["n_r"]).abs() / want["n_r"] <= 0.2]
    dl, dr = spark.createDataFrame(left), spark.createDataFrame(right)
    got = joins.band_pairs(dl, dr, "n_l", "n_r", 0.2).toPandas()
    assert set(zip(got["l"], got["r"])) == set(zip(want["l"], want["r"]))
    agg = joins.band_aggregate(dl, dr, "n_l", "n_r", "v", 0.2).toPandas().set_index("l")
    for i in left["l"]:
        part = want[want["l"] == i]
        assert agg.loc[i, "n_pairs"] == len(part) and agg.loc[i, "partner_sum"] == pytest.approx(part["v"].sum())


def test_history_is_strict_and_padded(spark):
    balls = spark.createDataFrame([("s", float(t), i, float(10 * i)) for i, t in enumerate([1, 2, 3, 5])], "k string, t double, b bigint, x double")
    asks = spark.createDataFrame([("s", 3.0, 7), ("s", 0.5, 8), ("u", 1.0, 9)], "k string, t double, a bigint")
    h = {r["a"]: (r["x"], r["mask"]) for r in joins.history(asks, balls, ["k"], "t", "a", "b", ["x"], 3).collect()}
    assert h[7] == ([0.0, 0.0, 10.0], [False, True, True])  # the row at t = 3 itself is not seen
    assert h[8] == ([0.0, 0.0, 0.0], [False, False, False])
    assert h[9] == ([None, None, None], [False, False, False])


def test_one_to_one_guards(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="repeats"):
        joins.one_to_one(a, spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double"), ["k"], "v")
    with pytest.raises(joins.MissingRows):
        joins.one_to_one(a, spark.createDataFrame([(1, 2.0)], "k int, v double"), ["k"], "v")


def test_metrics_with_and_without_baseline_alarms(spark):
    df = spark.createDataFrame([(3, 0, 100, 500), (0, 0, 100, 500), (4, 2, 100, 500), (4, 2, 100, 0)], "p int, b int, br int, pr int")
    c = [F.col(x) for x in ("p", "b", "br", "pr")]
    got = [r[0] for r in df.select(metrics.operational_snr(*c)).collect()]
    assert got == [9999.0, 0.0, 0.4, 0.0]
    low, high = metrics.wilson(F.lit(0), F.lit(0))
    assert tuple(df.select(low, high).first()) == (0.0, 0.0)
    low, high = metrics.wilson(F.lit(2), F.lit(48000))
    lo, hi = df.select(low, high).first()
    assert lo == pytest.approx(0.0114, abs=1e-4) and hi == pytest.approx(0.1519, abs=1e-4)


def test_configurations_without_alarms_are_scored(spark):
    pdf = pd.DataFrame({"k": "s", "o": range(30), "year": [1] * 10 + [2] * 20})
    s = ordered.series(spark.createDataFrame(pdf), ["k"], ["o"])
    alarms = spark.createDataFrame([("s", "x", 3), ("s", "x", 15), ("s", "x", 29)], "k string, cfg string, idx bigint")
    got = {r["cfg"]: r for r in evaluate.evaluate(alarms, s, ["x", "y"], 1, [2]).collect()}
    assert (got["x"]["n_base"], got["x"]["n_post"], got["x"]["far_per_1k"], got["x"]["year_coverage"]) == (1, 2, 100.0, 1)
    assert (got["y"]["n_alarms"], got["y"]["year_coverage"], got["y"]["efficiency"]) == (0, 0, 0.0)
