"""Change points against brute force; density ratios against dense formulas."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import changepoint as C
from tidemark.operators import ratio as R
from tidemark.operators.ordered import series


def kernel_cost(x, s, e, gamma):
    k = np.exp(-gamma * (x[s:e, None] - x[None, s:e]) ** 2)
    return (e - s) - k.sum() / (e - s)


def all_splits(n, most, least):
    for k in range(most + 1):
        for cuts in itertools.combinations(range(least, n - least + 1), k):
            ends = [0, *cuts, n]
            if all(b - a >= least for a, b in zip(ends, ends[1:])):
                yield list(cuts), ends


def jump_series(n=14, seed=1):
    x = np.random.default_rng(seed).normal(size=n)
    x[n // 2:] += 3
    return x


def test_break_curve_is_the_brute_force_optimum():
    x = jump_series()
    g = C.median_gamma(x)
    best = {}
    for cuts, ends in all_splits(len(x), 3, 2):
        c = sum(kernel_cost(x, a, b, g) for a, b in zip(ends, ends[1:]))
        if c < best.get(len(cuts), (np.inf,))[0]:
            best[len(cuts)] = (c, cuts)
    for k, cost, cuts in C.best_breaks(x, 3, g):
        assert cost == pytest.approx(best[k][0]) and cuts == best[k][1]


def test_penalised_breaks_are_the_brute_force_optimum():
    x = jump_series(12, 4)
    g = C.median_gamma(x)
    for pen, cuts in zip([0.2, 1.0, 5.0], C.penalised_breaks(x, [0.2, 1.0, 5.0], g)):
        best = min(all_splits(len(x), 5, 2), key=lambda s: sum(kernel_cost(x, a, b, g) + pen for a, b in zip(s[1], s[1][1:])))
        assert cuts == best[0]


@pytest.mark.parametrize("x", [[1.0, 2.0, 4.0, 8.0, 9.5], [1.0, 1.0, 2.0, 5.0], [3.0, 3.0, 3.0]])
def test_median_widths(x):
    x = np.array(x)
    d = np.array([(a - b) ** 2 for a, b in itertools.combinations(x, 2)])
    positive = d[d > 0]
    assert C.median_gamma(x) == pytest.approx(1 / (2 * np.median(positive)) if len(positive) else 1.0)
    assert C.median_gamma(x, ruled=True) == pytest.approx(1 / np.median(d) if np.median(d) else 1.0)


def plain_run_length(x, hazard, gap):
    mu0, b0 = x.mean(), x.var()
    logr, stats, likely, out = [0.0], [(mu0, 1.0, 1.0, b0)], 0, []
    for t, v in enumerate(x):
        joint = []
        for lr, (m, k, a, b) in zip(logr, stats):
            s2, nu = b * (k + 1) / (a * k), 2 * a
            joint.append(lr + math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * s2)
                         - (nu + 1) / 2 * math.log1p((v - m) ** 2 / (nu * s2)))
        new = [np.logaddexp.reduce(joint) + math.log(hazard)] + [j + math.log(1 - hazard) for j in joint]
        logr = list(np.array(new) - np.logaddexp.reduce(new))
        stats = [(mu0, 1.0, 1.0, b0)] + [((k * m + v) / (k + 1), k + 1, a + 0.5, b + k * (v - m) ** 2 / (2 * (k + 1))) for m, k, a, b in stats]
        now = int(np.argmax(logr))
        if now < likely and likely > gap:
            out.append(t)
        likely = now
    return out


def test_run_length_breaks(spark):
    x = np.r_[np.random.default_rng(0).normal(0, 1, 40), np.random.default_rng(1).normal(6, 1, 40), np.random.default_rng(2).normal(0, 1, 40)]
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "o": range(120), "v": x}))
    got = sorted(r["idx"] for r in C.run_length_breaks(series(df, ["k"], ["o"]), "v", 0.02).collect())
    want = plain_run_length(x, 0.02, 3)
    assert got == want and len(want) >= 2


FEATURES = ["a", "b"]


def two_samples(spark, n=240, shift=0.8):
    rng = np.random.default_rng(3)
    base = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    target = pd.DataFrame({"id": range(n, 2 * n), "a": rng.normal(shift, 1, n), "b": rng.normal(size=n), "p": 1})
    return base, target, spark.createDataFrame(base).repartition(3), spark.createDataFrame(target).repartition(4)


@pytest.mark.parametrize("alpha", [None, 0.1])
def test_ratio_equals_the_dense_solution(spark, alpha):
    base, target, db, dt = two_samples(spark)
    fit = R.fit_ratio(db, dt, "p", FEATURES, "id", 40, alpha=alpha)
    got = fit.weigh(dt, "p", ["id"]).toPandas().sort_values("id")["w"].to_numpy()
    m = fit.models[(1, "all")]
    pooled = np.vstack([base[FEATURES], target[FEATURES]])
    scale = lambda x: (x[FEATURES].to_numpy() - pooled.mean(0)) / pooled.std(0)
    xs, xt = scale(target), scale(base)
    k = lambda x: np.exp(-((x[:, None, :] - m["centres"][None]) ** 2).sum(2) / (2 * m["sigma"] ** 2))
    ps, pt = k(xs), k(xt)
    h = pt.mean(0)
    big = ps.T @ ps / len(ps) if alpha is None else (1 - alpha) / len(pt) * pt.T @ pt + alpha / len(ps) * ps.T @ ps
    r = np.maximum(ps @ np.linalg.solve(big + 1e-3 * np.eye(len(h)), h), 0)
    np.testing.assert_allclose(got, r / r.mean(), rtol=1e-6, atol=1e-8)
    assert got.mean() == pytest.approx(1.0)
    # rows that look like the baseline weigh more
    assert np.corrcoef(got, target["a"])[0, 1] < -0.3


def test_self_test_changes_little(spark):
    base, _, db, _ = two_samples(spark, 400)
    r = R.self_test(db.withColumnRenamed("b", "e"), ["a"], "e", "id", 50).first()
    assert abs(r["delta"]) < 0.3 and 0 < r["ess_ratio"] <= 1 and r["calibrated"]


def dense_auc(base, target, held):
    """Fit by plain Newton steps on the rows not held out, area by comparing all held-out pairs."""
    x, y = np.vstack([base[FEATURES], target[FEATURES]]), np.r_[np.zeros(len(base)), np.ones(len(target))]
    x = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    beta, pen = np.zeros(3), np.array([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x[~held] @ beta))
        beta -= np.linalg.solve((x[~held] * (p * (1 - p))[:, None]).T @ x[~held] + np.diag(pen), x[~held].T @ (p - y[~held]) + pen * beta)
    z = x[held] @ beta
    a, b = z[y[held] == 0], z[y[held] == 1]
    return ((a[:, None] < b).mean() + (a[:, None] == b).mean() / 2)


def hashes(spark, ids, side):
    got = spark.createDataFrame([(int(i),) for i in ids], "id long").select("id", F.xxhash64(F.lit(42), F.lit(side), "id").alias("h")).toPandas()
    return got.set_index("id").loc[list(ids)]["h"].to_numpy().view(np.uint64)


def test_classifier_tells_samples_apart(spark):
    base, target, db, dt = two_samples(spark, 300, 1.5)
    r = R.two_sample_classifier(db, dt, "p", FEATURES, "id", permutations=50).first()
    held = R._draws(np.r_[hashes(spark, base["id"], 0), hashes(spark, target["id"], 1)], 1) < R.HELD_OUT
    assert r["auc"] == pytest.approx(dense_auc(base, target, held), abs=1e-9)
    assert r["auc"] > 0.75 and r["p_value"] == 0.0 and r["n_permut"] == 50 and r["n_sub"] == 300
    _, _, db, dt = two_samples(spark, 300, 0.0)
    assert R.two_sample_classifier(db, dt, "p", FEATURES, "id", permutations=50).first()["p_value"] > 0.0


def test_classifier_takes_every_key_in_blocks(spark):
    base, target, db, _ = two_samples(spark, 200, 1.0)
    many = pd.concat([target.assign(p=k, id=target["id"] + 1000 * k, a=target["a"] - 0.5 * k) for k in range(3)])
    dt = spark.createDataFrame(many)
    one, two = ({r["p"]: r for r in R.two_sample_classifier(db, dt, "p", FEATURES, "id", permutations=20, block=b).collect()} for b in (1, 32))
    assert set(one) == {0, 1, 2}
    for k in one:
        assert one[k]["auc"] == pytest.approx(two[k]["auc"], abs=1e-9) and one[k]["p_value"] == two[k]["p_value"]
    assert one[0]["auc"] > one[1]["auc"] > 0.5
    assert R.two_sample_classifier(db, dt.where("p > 9"), "p", FEATURES, "id", permutations=5).count() == 0


def test_run_lengths_of_a_long_series_in_bounded_time():
    """Work for a row is a few passes over arrays; pieces of a series give what the whole gives."""
    import time

    x = np.random.default_rng(3).normal(50, 9, 9000)
    x[3000:3500] += 30
    p = {"hazard": 0.1, "mu": 50.0, "kappa": 1.0, "alpha": 1.0, "beta": 90.0}
    begun = time.process_time()
    hits, stop = C.RunLength.run(p, C.RunLength.cold(p), x[:0], x, (0.0, 0.0))
    assert time.process_time() - begun < 25
    state, parts = C.RunLength.cold(p), []
    for a, b in ((0, 1), (1, 700), (700, 9000)):
        found, state = C.RunLength.run(p, state, x[:0], x[a:b], (0.0, 0.0))
        parts += (a + found).tolist()
    assert parts == hits.tolist() and np.allclose(state, stop, rtol=1e-9)
