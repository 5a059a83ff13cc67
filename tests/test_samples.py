"""Hash samples, bootstraps, replays and permutations."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions.hashing import POISSON_STEPS, PRIME, row_hash
from tidemark.operators import ordered
from tidemark.operators import sampling as M
from tidemark.operators.distance import ks_p_values


def ids(spark, n=5000):
    return spark.range(n).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 17).cast("double").alias("v"))


def test_cap_keeps_the_smallest_hashes_of_each_key(spark):
    df = ids(spark).withColumn("k", F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 40))
    got = M.hash_cap(df, ["k"], "id", 50).select("k", "id").toPandas()
    h = df.withColumn("h", row_hash("id")).toPandas().sort_values(["k", "h", "id"])
    want = h.groupby("k").head(50)
    assert set(zip(got["k"], got["id"])) == set(zip(want["k"], want["id"]))


def test_cap_is_the_same_for_any_partitioning(spark):
    a = {r["id"] for r in M.hash_cap(ids(spark).repartition(1), [], "id", 100).collect()}
    b = {r["id"] for r in M.hash_cap(ids(spark).repartition(13), [], "id", 100).collect()}
    assert a == b and len(a) == 100


def test_bootstrap_spread_matches_theory(spark):
    df = ids(spark, 2000)
    reps = M.replicate_sums(df, [], F.col("id"), 200, {"s": F.col("v")}).toPandas()
    means = reps["s"] / reps["n"]
    x = df.toPandas()["v"]
    assert means.std() == pytest.approx(x.std() / np.sqrt(len(x)), rel=0.2)
    assert means.mean() == pytest.approx(x.mean(), abs=0.05)


def test_interval_holds_the_mean(spark):
    r = M.bootstrap_mean(ids(spark, 900), ["k"], "v", "id", 100).collect()
    assert all(x["lo"] < x["mean"] < x["hi"] for x in r) and len(r) == 3


def test_weighted_draws_follow_the_weights(small_chunks):
    df = small_chunks.createDataFrame(pd.DataFrame({"id": range(400), "w": [0.0] * 200 + [1.0] * 100 + [3.0] * 100}))
    d = M.weighted_draws(df, "w", "id", 3000).toPandas()
    assert len(d) == 3000 and d["draw"].nunique() == 3000
    assert (d["id"] < 200).sum() == 0
    assert (d["id"] >= 300).mean() == pytest.approx(0.75, abs=0.04)


def test_block_draws_take_as_many_blocks_as_there_are(spark):
    blocks = spark.createDataFrame([("a", i, 1, float(i)) for i in range(6)], "k string, g int, n int, sx double")
    r = M.block_draws(blocks, ["k"], "g", 40, ["n", "sx"]).toPandas()
    assert (r["n"] == 6).all() and len(r) == 40 and r["sx"].nunique() > 5


def test_folds_take_every_other_game(spark):
    df = spark.createDataFrame([(y, f"g{i}") for y in (1, 2) for i in range(5)], "year int, game string")
    a = {(r["year"], r["game"]): r["split"] for r in M.game_folds(df, "year", "game", "A").collect()}
    b = {(r["year"], r["game"]): r["split"] for r in M.game_folds(df, "year", "game", "B").collect()}
    assert [a[(1, f"g{i}")] for i in range(5)] == ["calib", "test", "calib", "test", "calib"]
    assert all(a[k] != b[k] for k in a)


def test_baseline_year_keeps_all_games(spark):
    df = spark.createDataFrame([(y, f"g{i}") for y in (1, 2) for i in range(6)], "year int, game string")
    n = {r["year"]: r["count"] for r in M.stratified_units(df, "year", "game", 2, [1]).groupBy("year").count().collect()}
    assert n == {1: 6, 2: 2}


def test_replicate_sums_equal_a_loop(spark):
    """Negative and huge ids, null ids, values and keys, several batches and early sends."""
    rows = [(None if i % 50 == 9 else i * 7919 * (-1) ** i + (i % 3) * 2**60, None if i % 5 == 0 else f"k{i % 4}", None if i % 11 == 0 else i / 7) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, v double").repartition(3)
    got = {(r["k"], r["rep"]): (r["n"], r["s"]) for r in M.replicate_sums(df, ["k"], F.col("id"), 30, {"s": F.col("v")}, 5).collect()}
    want = {}
    for i, k, v in rows:
        for rep in range(5, 35) if i is not None else ():
            i0 = i % PRIME
            a = (i0 * 48271 + rep * 69621 + 12345) % PRIME
            b = (a * a + a * 48271 + rep) % PRIME
            n = sum((b * b + i0) % PRIME / PRIME >= step for step in POISSON_STEPS)
            old = want.get((k, rep), (0, 0.0))
            want[k, rep] = (old[0] + n, old[1] + n * (v or 0.0))
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and got[k][1] == pytest.approx(s, rel=1e-12, abs=1e-12) for k, (n, s) in want.items())
    one = M.replicate_sums(df, [], F.col("id"), 7, {"s": F.col("v"), "t": F.lit(1)}).collect()
    assert len(one) == 7 and all(r["t"] == r["n"] for r in one)


def test_folded_draws_equal_the_steps_of_uniform():
    """Also at the ends of the range of ids and where a numerator meets a step."""
    rng = np.random.default_rng(6)
    ids = np.concatenate([[0, 1, PRIME - 2, PRIME - 1], rng.integers(0, PRIME, 3000)])
    rep = np.arange(400, dtype=np.int64)
    want = np.searchsorted(POISSON_STEPS, hashing.uniform_array(ids[:, None], rep), "right")
    assert (hashing.poisson_array(ids, rep) == want).all() and want.max() >= 7
    for step, bound in zip(POISSON_STEPS, hashing._BOUNDS.tolist()):
        assert bound / PRIME >= step > (bound - 1) / PRIME


def test_replicates_are_drawn_once(spark):
    """An interval reads the replicates several times; the rows are drawn for one time only."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    rows = spark.range(40).select("id", (F.col("id") % 2).alias("k"), counted(F.col("id").cast("double")).alias("v"))
    sums = M.replicate_sums(rows, ["k"], F.col("id"), 50, {"s": F.col("v")})
    assert M.interval(sums.withColumn("m", F.try_divide("s", "n")), ["k"], "m").count() == 2 and sums.count() == 100
    assert seen.value == 40


@pytest.mark.parametrize("scheme", ["full", "within", "blocks"])
def test_permuted_positions_are_permutations(spark, scheme):
    rows = [("ab"[i % 2], f"g{i // (7 + i % 2 * 9)}", i) for i in range(300)] + [("one", "g", 0)]
    s = ordered.series(spark.createDataFrame(rows, "k string, g string, o long"), ["k"], ["o"], "at")
    real = s.df.toPandas()
    p = M.permuted(s, scheme, "g", 200).df.toPandas()
    assert p.groupby(["k", "rep"])["at"].apply(lambda v: sorted(v) == list(range(len(v)))).all() and len(p) == 200 * len(real)
    first = {key: v for key, v in real.groupby(["k", "g"])["at"].min().items()}
    for (k, _), part in p.sort_values("at").groupby(["k", "rep"]):
        if scheme != "full":
            runs = (part["g"] != part["g"].shift()).sum()
            assert runs == part["g"].nunique()
        if scheme == "within":
            assert part["g"].drop_duplicates().tolist() == sorted(part["g"].unique(), key=lambda g: first[k, g])
        if scheme == "blocks":
            assert all((np.diff(v) > 0).all() for _, v in part.groupby("g")["o"])
    if scheme == "full":  # every row comes to every tenth of the series about equally often
        a = p[p["k"] == "a"]
        seen = np.histogram2d(a["o"], a["at"], bins=10)[0]
        assert abs(seen / seen.mean() - 1).max() < 0.35


@pytest.mark.parametrize("scheme", ["full", "within", "blocks"])
def test_packed_permutations_have_the_alarms_of_permuted_rows(small_chunks, monkeypatch, scheme):
    from tidemark.operators import studies
    from tidemark.operators.detectors.linked import detect

    monkeypatch.setattr(M, "PACK", 50)
    rng = np.random.default_rng(5)
    x = np.where(np.arange(1400) // 100 % 2 == 0, 5.0, 9.0) + rng.normal(0, 1, 1400)
    rows = [("abn"[i % 2] if i else None, f"g{i // 90}" if i % 50 else None, i, float(v) if i % 31 else (None if i % 2 else float("nan"))) for i, v in enumerate(x)]
    s = ordered.series(small_chunks.createDataFrame(rows, "k string, g string, o long, x double"), ["k"], ["o"])
    config = {"cfg": "c", "detector": "mean_split", "delta": 0.2, "min_window": 20, "cooldown": 10, "max_window": 120}
    permuted = M.permuted(s, scheme, "g", 6)
    want = {(r["k"], r["rep"]): r["n"] for r in detect(permuted, "x", [config]).groupBy("k", "rep").agg(F.count(F.lit(1)).alias("n")).collect()}
    packed = M.packed_permutations(s, "x", scheme, "g", 6, 300)
    assert packed.count() < permuted.df.count() / 5
    got = {(r["k"], r["rep"]): r["k_"] for r in studies.permuted_alarms(s, "x", config, scheme, "g", 6).toDF("k", "rep", "k_").collect()}
    assert got == want and len(want) > 6


@pytest.mark.parametrize(("n", "start", "rep"), [(1, 0, 0), (2, 5, 3), (7, 0, 1), (1000, 123, 199), (40_000, 0, 5), (20_000, 10**8, 7)])
def test_values_are_shuffled_in_place_as_by_places(n, start, rep):
    from tidemark.functions.hashing import shuffle_values, shuffled_array

    x, want = np.random.default_rng(n).normal(size=n), np.empty(n)
    want[shuffled_array(np.arange(n), np.int64(n), np.int64(start), np.int64(rep))] = x
    shuffle_values(x, start, rep)
    assert (x == want).all()


@pytest.mark.parametrize("scheme", ["full", "within", "blocks"])
def test_replicates_are_permuted_inside_tasks(small_chunks, monkeypatch, scheme):
    from tidemark.operators import studies
    from tidemark.operators.detectors.linked import detect

    rng = np.random.default_rng(6)
    x = np.where(np.arange(1500) // 100 % 2 == 0, 5.0, 9.0) + rng.normal(0, 1, 1500)
    rows = [("abn"[i % 2] if i else None, f"g{i // 300}" if i % 50 else None, i, float(v) if i % 31 else (None if i % 2 else float("nan"))) for i, v in enumerate(x)]
    s = ordered.series(small_chunks.createDataFrame(rows, "k string, g string, o long, x double"), ["k"], ["o"])
    config = {"cfg": "c", "detector": "mean_split", "delta": 0.2, "min_window": 20, "cooldown": 10, "max_window": 120}
    found = detect(M.permuted(s, scheme, "g", 6), "x", [config]).groupBy("k", "rep").agg(F.count(F.lit(1)).alias("n"))
    want = {(r["k"], r["rep"]): r["n"] for r in found.collect()}

    def got():
        return {(r["k"], r["rep"]): r["k_"] for r in studies.permuted_alarms(s, "x", config, scheme, "g", 6).toDF("k", "rep", "k_").collect()}

    with monkeypatch.context() as patch:
        patch.setattr(studies, "HELD", 0)
        assert got() == want and len(want) > 6
    # no row, pack or value of a replicate leaves a task
    monkeypatch.setattr(studies, "packed_permutations", None)
    monkeypatch.setattr(M, "PACK", 50)
    assert got() == want
    monkeypatch.setattr(M, "FEW", 20)
    monkeypatch.setattr(studies, "TASKS", 0)
    assert got() == want
    assert M.packed_series(s, "x", scheme, "g").count() < len(rows) / 10


def plain_p(a, b):
    """Share of all ways to choose the rows of the first side whose distance is as large."""
    pool = sorted(a + b)

    def gap(first):
        rest = list(pool)
        for x in first:
            rest.remove(x)
        return max(abs(sum(x <= v for x in first) * len(b) - sum(x <= v for x in rest) * len(a)) for v in set(pool))

    ways = [gap([pool[i] for i in c]) for c in combinations(range(len(pool)), len(a))]
    return sum(g >= gap(a) for g in ways) / len(ways)


def test_ks_p_values_count_all_orders(spark):
    rng = random.Random(3)
    sides = {"published 4/5": ([1, 2, 3, 4, 9], [5, 6, 7, 8, 10]), "apart": ([1, 2, 3, 4, 5], [6, 7, 8, 9, 10]), "equal": ([1, 2], [1, 2])}
    for k in range(12):  # ties, and sides of different sizes
        sides[f"drawn {k}"] = tuple([rng.randrange(4 + k) for _ in range(rng.randrange(1, 7))] for _ in range(2))
    rows = [(g, float(v), s == 0) for g, both in sides.items() for s in (0, 1) for v in both[s]] + [("one side", 1.0, True), ("nan", float("nan"), False)]
    df = spark.createDataFrame(rows, "k string, v double, a boolean")
    got = {r["k"]: r["p"] for r in ks_p_values(df, ["k"], "v", F.col("a")).collect()}
    assert got["published 4/5"] == pytest.approx(20 / 252) and got["apart"] == pytest.approx(2 / 252) and got["equal"] == 1.0
    assert got == {g: pytest.approx(plain_p(*both)) for g, both in sides.items()}


def test_ks_p_values_of_large_sides_follow_the_series(spark):
    df = spark.range(4000).select(F.col("id").alias("v"), (F.col("id") % 2 == 0).alias("a"), F.lit("k").alias("k"))
    moved = df.withColumn("v", F.when(F.col("a"), F.col("v") + 172).otherwise(F.col("v")))
    near, far = (ks_p_values(d, ["k"], "v", F.col("a")).first() for d in (df, moved))
    assert near["p"] == 1.0
    z = far["ks"] * np.sqrt(1000)
    assert far["p"] == pytest.approx(2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * z * z) for k in range(1, 50)), rel=1e-9)
    close = [ks_p_values(moved.where("v % 40 < 6"), ["k"], "v", F.col("a"), exact=bound).first()["p"] for bound in (0, 10**6)]
    assert close[0] == pytest.approx(close[1], abs=0.05)
