"""Series, prefix sums, frames and quantiles on split and whole paths."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import distance, ordered, quantiles
from tidemark.operators.smoothers import smooth


def skewed(spark, n=1500, seed=0):
    """One key holds most rows; values repeat."""
    rng = np.random.default_rng(seed)
    k = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    pdf = pd.DataFrame({"k": k, "o": rng.permutation(n), "v": np.round(rng.gamma(2, 3, n), 1)})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_positions_are_dense_and_ordered(small_chunks):
    pdf, df = skewed(small_chunks)
    s = ordered.series(df, ["k"], ["o"])
    assert s.longest > 200  # beyond the bound, so the range path ran
    got = s.df.toPandas().sort_values(["k", "o"])
    want = pdf.sort_values(["k", "o"]).groupby("k").cumcount()
    assert got["idx"].tolist() == want.tolist()


@pytest.mark.parametrize("split", [False, True])
def test_prefix_sums(spark, split):
    pdf, df = skewed(spark)
    out = ordered.running(df, ["k"], ["o"], {"before": F.col("v")}, {"total": "before"}, split).toPandas().sort_values(["k", "o"])
    pdf = pdf.sort_values(["k", "o"])
    want = pdf.groupby("k")["v"].cumsum() - pdf["v"]
    np.testing.assert_allclose(out["before"], want, atol=1e-9)
    np.testing.assert_allclose(out["total"], pdf.groupby("k")["v"].transform("sum"), atol=1e-9)


def test_frames_cross_chunk_borders(small_chunks):
    pdf, df = skewed(small_chunks)
    s = ordered.series(df, ["k"], ["o"])
    out = ordered.framed(s, lambda w: {"m": F.max("v").over(w.rowsBetween(-50, 7))}, 50, 7).toPandas().sort_values(["k", "o"])
    for k, part in pdf.sort_values(["k", "o"]).groupby("k"):
        v = part["v"].to_numpy()
        want = [v[max(0, i - 50):i + 8].max() for i in range(len(v))]
        assert out[out["k"] == k]["m"].tolist() == want


@pytest.mark.parametrize("kind,params", [
    ("sma", {"w": 20}), ("med", {"w": 50}), ("robz", {"w": 30}), ("ewma", {"alpha": 0.3}), ("holt", {"alpha": 0.4, "beta": 0.2}),
    ("savgol", {"w": 51, "degree": 3})])
def test_smoothers_do_not_depend_on_chunks(small_chunks, kind, params):
    from tidemark.functions import smoothing

    pdf, df = skewed(small_chunks)
    s = ordered.series(df, ["k"], ["o"])
    out = smooth(s, "v", kind, params).toPandas().sort_values(["k", "idx"])
    for k, part in pdf.sort_values(["k", "o"]).groupby("k"):
        want = smoothing.apply(kind, params, part["v"].to_numpy(), True, True)
        np.testing.assert_allclose(out[out["k"] == k]["smooth"], want, atol=1e-7)


def test_local_polynomial_fits_each_window():
    from tidemark.functions.smoothing import local_polynomial

    x = np.random.default_rng(1).normal(size=60)
    got = local_polynomial(x, 11, 3, True, True)
    t = np.arange(11)
    for i in range(5, 55):
        assert got[i] == pytest.approx(np.polyval(np.polyfit(t, x[i - 5:i + 6], 3), 5))
    head = np.polyfit(t, x[:11], 3)
    np.testing.assert_allclose(got[:5], np.polyval(head, np.arange(5)))
    assert local_polynomial(x[:3], 51, 3, True, True).tolist() == x[:3].tolist()


@pytest.mark.parametrize("split", [False, True])
def test_quantiles(spark, split):
    pdf, df = skewed(spark)
    probs = [0.0, 0.1, 0.5, 0.905, 1.0]
    got = {r["k"]: r for r in quantiles.exact_quantiles(df, ["k"], "v", probs, split=split).collect()}
    grid = quantiles.quantile_grid(df, ["k"], "v", 101, split=split).toPandas()
    for k, part in pdf.groupby("k"):
        np.testing.assert_allclose(got[k]["q"], np.quantile(part["v"], probs))
        assert got[k]["n"] == len(part)
        g = grid[grid["k"] == k].sort_values("j")
        np.testing.assert_allclose(g["q"], np.quantile(part["v"], np.linspace(0, 1, 101)))


def test_quantiles_of_one_row_and_of_equal_rows(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("b", 2.0)], "k string, v double")
    for split in (False, True):
        got = {r["k"]: r["q"] for r in quantiles.exact_quantiles(df, ["k"], "v", [0.1, 0.9], split=split).collect()}
        assert got == {"a": [3.0, 3.0], "b": [2.0, 2.0]}
        grid = quantiles.quantile_grid(df, ["k"], "v", 11, split=split).groupBy("k").agg(F.count("*").alias("n"), F.sum("q").alias("s"))
        assert {r["k"]: (r["n"], r["s"]) for r in grid.collect()} == {"a": (11, 33.0), "b": (11, 22.0)}


def plain_ks(a, b):
    at = np.unique(np.r_[a, b])
    return np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max()


def test_distances_to_a_baseline(small_chunks):
    pdf, df = skewed(small_chunks)
    base = small_chunks.createDataFrame(pd.DataFrame({"v": np.round(np.random.default_rng(5).gamma(2, 3.5, 700), 1)}))
    b = base.toPandas()["v"].to_numpy()
    got = distance.shift_table(df, ["k"], "v", base, store=True).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        q = np.linspace(0, 1, 2000)
        assert got.loc[k, "ks"] == pytest.approx(plain_ks(part["v"].to_numpy(), b))
        assert got.loc[k, "wd"] == pytest.approx(np.abs(np.quantile(part["v"], q) - np.quantile(b, q)).mean())


def test_distance_of_a_sample_to_itself_and_to_its_translate(spark):
    x = np.random.default_rng(42).normal(size=512)
    pdf = pd.DataFrame({"side": ["a"] * 512 + ["b"] * 512 + ["c"] * 512, "v": np.r_[x, x, x + 5.0]})
    df = spark.createDataFrame(pdf)
    same = distance.ks_two_sample(df.where("side <> 'c'"), [], "v", F.col("side") == "a").first()
    assert same["ks"] < 1e-9
    moved = distance.wasserstein_two_sample(df.where("side <> 'b'"), [], "v", F.col("side") == "a").first()
    assert moved["wd"] == pytest.approx(5.0, abs=1e-9)


def test_values_that_are_not_finite_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 1.0), ("b", float("inf")), ("b", None)], "s string, v double")
    assert distance.ks_two_sample(df, [], "v", F.col("s") == "a").first()["ks"] == 0.0


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double").withColumn("k", F.lit("a"))
    assert sorted(r["rank"] for r in quantiles.average_ranks(df, ["k"], "v").collect()) == [1.0, 2.5, 2.5, 4.0]


@pytest.mark.parametrize("split", [True, False])
def test_running_gives_the_next_value(small_chunks, split):
    rows = [(f"k{i % 3}", float(i * 37 % 101), 1) for i in range(100)] + [("one", 5.0, 1)]
    df = small_chunks.createDataFrame(rows, "k string, v double, c long").repartition(5)
    out = ordered.running(df, ["k"], ["v"], {"below": F.col("c")}, {}, split, {"above": "v"}).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"k", "v", "c", "below", "above"}
    for k in {r[0] for r in rows}:
        values = sorted(r[1] for r in rows if r[0] == k)
        got = {r["v"]: (r["below"], r["above"]) for r in out if r["k"] == k}
        assert got == {v: (i, values[i + 1] if i + 1 < len(values) else None) for i, v in enumerate(values)}


@pytest.mark.parametrize("chunks", [False, True])
def test_shift_table_reads_values_once_and_meets_no_slots(spark, request, chunks):
    """Values were read by every statistic, and two rows of every slot of every key met in one hash table."""
    if chunks:
        request.getfixturevalue("small_chunks")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    rng = np.random.default_rng(3)
    rows = [(f"k{i % 2}", i % 7, float(v)) for i, v in enumerate(rng.integers(0, 300, 1500))] + [("k0", 8, 4.0), ("k1", 9, float("nan")), ("k1", None, 2.0), ("k1", None, 7.0)]
    df = spark.createDataFrame(rows, "f string, k long, v double").repartition(4)
    base = df.where("k < 2")
    read = df.select("f", "k", counted("v").alias("v"))
    out = distance.shift_table(read, ["f", "k"], "v", base, ["f"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and re.search(r"\bj#", x)]
    got = {(r["f"], r["k"]): (r["ks"], r["wd"]) for r in out.collect()}
    assert seen.value <= 2 * len(rows)  # once, or once by the filter and once by the counts
    grid = np.linspace(0, 1, distance.GRID)
    for f, k in {r[:2] for r in rows if r[1] not in (9, None)}:
        x = np.sort([v for g, j, v in rows if (g, j) == (f, k)])
        y = np.sort([v for g, j, v in rows if g == f and j is not None and j < 2])
        at = np.concatenate([x, y])
        ks = np.abs(np.searchsorted(x, at, "right") / len(x) - np.searchsorted(y, at, "right") / len(y)).max()
        assert got[f, k] == pytest.approx((ks, np.abs(np.quantile(x, grid) - np.quantile(y, grid)).mean()), rel=1e-9)
    assert ("k1", 9) not in got and ("k1", None) not in got and len(got) == 15
