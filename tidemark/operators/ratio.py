"""Density ratios by least squares, importance weights and what they explain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import scalars
from tidemark.functions.hashing import row_hash
from tidemark.operators import sampling as M
from tidemark.operators.aggregates import weight_concentration
from tidemark.operators.ordered import running


def gaussian(x: np.ndarray, centres: np.ndarray, sigma: float) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * x @ centres.T
    return np.exp(-np.maximum(d2, 0.0) / (2.0 * sigma * sigma))


def _bandwidth(x: np.ndarray) -> float:
    n = (x * x).sum(1)
    d2 = np.maximum(n[:, None] + n[None, :] - 2.0 * x @ x.T, 0.0)
    d = np.sqrt(d2[np.triu_indices(len(x), 1)])
    d = d[d > 1e-12]
    return float(np.median(d)) if len(d) else 1.0


def pooled_scaling(base: DataFrame, target: DataFrame, key: str, features: list[str]) -> dict:
    """Mean and population deviation of baseline and target rows together, per key."""
    sums = lambda df, keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[
        e.alias(f"{t}_{f}") for f in features for t, e in (("s", F.sum(f)), ("q", F.sum(F.col(f) * F.col(f))))])
    b = sums(base, []).first()
    out = {}
    for r in sums(target, [key]).collect():  # one row per period
        n = b["n"] + r["n"]
        mean = np.array([(b[f"s_{f}"] + r[f"s_{f}"]) / n for f in features])
        square = np.array([(b[f"q_{f}"] + r[f"q_{f}"]) / n for f in features])
        std = np.sqrt(np.maximum(square - mean * mean, 0.0))
        out[r[key]] = {"mean": mean, "std": np.where(std > 0, std, 1.0), "n_base": int(b["n"]), "n": int(r["n"])}
    return out


class RatioFit:
    """Centres, width and coefficients per key and feature subset."""

    def __init__(self, features, subsets, models):
        self.features, self.subsets, self.models = features, subsets, models

    def weigh(self, target: DataFrame, key: str, keep: list[str]) -> DataFrame:
        """Weights of the target rows, with mean one per key and subset."""
        models, features, subsets = self.models, self.features, self.subsets
        names = {f.name: f.dataType.simpleString() for f in target.schema.fields}
        schema = ", ".join(f"`{c}` {names[c]}" for c in [key, *keep]) + ", subset string, r double"

        def ratios(pdf: pd.DataFrame) -> Iterator[tuple]:
            for k, part in pdf.groupby(key, sort=False):
                rows = part[features].to_numpy(dtype=float)
                for name in subsets:
                    m = models[(k, name)]
                    phi = gaussian(((rows - m["mean"]) / m["std"])[:, m["cols"]], m["centres"], m["sigma"])
                    yield k, part, name, np.maximum(phi @ m["theta"], 0.0)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, part, name, r in ratios(pdf):
                    yield part[[key, *keep]].assign(subset=name, r=r)

        def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict = {}
            for pdf in batches:
                for k, _, name, r in ratios(pdf):
                    s = sums.setdefault((k, name), [0.0, 0])
                    s[0], s[1] = s[0] + float(r.sum()), s[1] + len(r)
            if sums:
                yield pd.DataFrame([(*k, *s) for k, s in sums.items()], columns=[key, "subset", "s", "n"])

        raw = target.select(key, *keep, *features).mapInPandas(score, schema)
        # the means need no row per subset: every task gives its sums
        sums = target.select(key, *features).mapInPandas(total, f"`{key}` {names[key]}, subset string, s double, n long")
        mean = sums.groupBy(key, "subset").agg((F.sum("s") / F.sum("n")).alias("_m"))
        return raw.join(mean, [key, "subset"]).select(
            key, *keep, "subset", F.when(F.col("_m") > 0, F.col("r") / F.col("_m")).otherwise(F.col("r")).alias("w"))


def fit_ratio(
    base: DataFrame, target: DataFrame, key: str, features: list[str], row_id: str, n_centres: int = 300, reg: float = 1e-3,
    alpha: float | None = None, subsets: dict[str, list[str]] | None = None, seed: int = 42,
) -> RatioFit:
    """Ratio baseline/target at the target rows, for every key at once.

    LSIF for ``alpha`` None, the relative form otherwise.  Rows never leave their
    partition: each one yields the sums of kernel products (centres squared), the
    sums are added in two rounds, and only these matrices reach the driver.
    """
    subsets = subsets or {"all": features}
    scaling = pooled_scaling(base, target, key, features)
    picked = M.hash_cap(base.select(row_id, *features), [], row_id, n_centres, seed).orderBy(row_id)
    centres = picked.limit(n_centres).toPandas()[features].to_numpy(dtype=float)
    both = base.select(row_id, *features).withColumn("_side", F.lit(0)).withColumn(key, F.explode(F.array(*[F.lit(k) for k in scaling])))
    both = both.unionByName(target.select(row_id, *features, key).withColumn("_side", F.lit(1)))
    cols = {n: [features.index(f) for f in fs] for n, fs in subsets.items()}
    sample = M.hash_cap(both.withColumn("_id", F.concat_ws(":", F.col("_side"), F.col(row_id))), [key], "_id", 2000, seed)
    names = {f.name: f.dataType.simpleString() for f in both.schema.fields}

    def widths(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = scaling[k[0]]
        x = (pdf[features].to_numpy(dtype=float) - s["mean"]) / s["std"]
        return pd.DataFrame({key: k[0], "subset": list(cols), "sigma": [_bandwidth(x[:, c]) for c in cols.values()]})

    sigma = {(r[key], r["subset"]): r["sigma"] for r in sample.groupBy(key).applyInPandas(
        widths, f"`{key}` {names[key]}, subset string, sigma double").collect()}
    models = {}
    for k, s in scaling.items():
        own = centres[:max(1, min(n_centres, s["n_base"], s["n"]))]  # no more than the rows of this key's pair of samples
        for name, c in cols.items():
            models[(k, name)] = {**s, "cols": c, "sigma": sigma[(k, name)], "centres": ((own - s["mean"]) / s["std"])[:, c]}

    def products(side: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grams: dict = {}
            for pdf in batches:
                parts = pdf.groupby(key, sort=False) if side else [(k, pdf) for k in scaling]
                for k, part in parts:
                    raw = part[features].to_numpy(dtype=float)
                    for name in cols:
                        m = models[(k, name)]
                        phi = gaussian(((raw - m["mean"]) / m["std"])[:, m["cols"]], m["centres"], m["sigma"])
                        g = grams.setdefault((k, name), [np.zeros((phi.shape[1],) * 2), np.zeros(phi.shape[1])])
                        if side or alpha is not None:
                            g[0] += phi.T @ phi
                        g[1] += phi.sum(0)
            if grams:
                yield pd.DataFrame({
                    key: [k for k, _ in grams], "subset": [n for _, n in grams], "side": side, "slot": TaskContext.get().partitionId() % 16,
                    "gram": [g[0].ravel() for g in grams.values()], "total": [g[1] for g in grams.values()]})
        return run

    schema = f"`{key}` {names[key]}, subset string, side int, slot int, gram array<double>, total array<double>"
    sums = target.select(key, *features).mapInPandas(products(1), schema).unionByName(
        base.select(*features).mapInPandas(products(0), schema))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[[0]].copy()
        out["gram"], out["total"] = [np.sum(np.stack(pdf["gram"]), axis=0)], [np.sum(np.stack(pdf["total"]), axis=0)]
        return out

    sums = sums.groupBy(key, "subset", "side", "slot").applyInPandas(add, schema)
    for r in sums.groupBy(key, "subset", "side").applyInPandas(add, schema).toLocalIterator():
        m = models[(r[key], r["subset"])]
        size = len(r["total"])
        m[f"gram{r['side']}"] = np.array(r["gram"]).reshape(size, size)
        m[f"total{r['side']}"] = np.array(r["total"])
    for m in models.values():
        h = m["total0"] / m["n_base"]
        if alpha is None:
            big = m["gram1"] / m["n"]
        else:
            big = (1.0 - alpha) / m["n_base"] * m["gram0"] + alpha / m["n"] * m["gram1"]
        m["theta"] = np.linalg.solve(big + reg * np.eye(len(h)), h)
        for name in ("gram0", "gram1", "total0", "total1"):
            m.pop(name, None)
    return RatioFit(features, subsets, models)


def decomposition(
    weighted: DataFrame, base: DataFrame, key: str, value: str, row_id: str, block: str, reps: int = 2000,
) -> DataFrame:
    """Error, weighted error, effective size, recovered share and intervals per key.

    ``weighted`` has (key, row id, block, value, w); ``base`` the baseline rows.
    """
    weighted = session.cut(weighted.select(key, row_id, block, value, "w"))
    core = weight_concentration(weighted, [key], "w", value, row_id)
    mean = weighted.groupBy(key).agg(F.avg(value).alias("ade_y"))
    base_mean = base.agg(F.avg(value)).scalar()
    core = core.join(mean, key).withColumn("ade_base", base_mean).withColumnRenamed("weighted_mean", "ade_iw")
    core = core.select("*", *[c.alias(n) for n, c in scalars.recovery_columns(
        F.col("ade_y"), F.col("ade_iw"), F.col("ade_base")).items()],
        scalars.regime(F.col("ess_ratio")).alias("ess_regime"), (F.col("ade_y") - F.col("ade_iw")).alias("iw_correction"),
        F.try_divide("ade_iw", "ade_base").alias("iw_to_base"))
    base_reps = M.replicate_sums(base, [], F.col(row_id), reps, {"s": F.col(value)}).select(
        "rep", F.try_divide("s", "n").alias("base_mean"))
    draws = session.cut(M.bootstrap_weighted(weighted, base_reps, [key], value, "w", row_id, reps))
    named = lambda df, p: df.withColumnsRenamed({"lo": f"{p}_lo", "hi": f"{p}_hi"})
    out = core
    for stat, p in (("mean", "ade_y"), ("iw", "ade_iw"), ("recovery", "recovery")):
        out = out.join(named(M.interval(draws, [key], stat), p), key, "left")
    blocks = M.block_draws(M.block_sums(weighted, [key], block, value, "w"), [key], block, reps, ["n", "sx", "sw", "swx"])
    blocks = blocks.withColumn("correction", F.col("sx") / F.col("n") - F.col("swx") / F.greatest("sw", F.lit(1e-9)))
    out = out.join(named(M.interval(blocks, [key], "correction"), "block"), key, "left")
    positive = F.when(F.col("excess_total") > 1e-6, F.col("excess_total"))
    return out.withColumn("block_recovery_lo", F.col("block_lo") / positive * 100).withColumn(
        "block_recovery_hi", F.col("block_hi") / positive * 100)


def subset_table(weighted: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """Weighted error and recovered share of every feature subset (one or all but one)."""
    sw = F.sum("w")
    m = weighted.groupBy(key, "subset").agg(
        F.avg(value).alias("ade_y"), F.try_divide(F.sum(F.col("w") * F.col(value)), sw).alias("ade_iw"),
        F.try_divide(sw * sw, F.count(F.lit(1)) * F.sum(F.col("w") * F.col("w"))).alias("ess_ratio"))
    m = m.withColumn("_base", base.agg(F.avg(value)).scalar())
    cols = scalars.recovery_columns(F.col("ade_y"), F.col("ade_iw"), F.col("_base"))
    return m.select(key, "subset", "ade_iw", "ess_ratio", cols["recovery_raw"].alias("recovery_raw"), cols["recovery_pct"].alias("recovery_pct"))


def single_and_left_out(features: list[str]) -> dict[str, list[str]]:
    out = {f"only_{f}": [f] for f in features}
    out.update({f"without_{f}": [g for g in features if g != f] for f in features})
    return out


def self_test(base: DataFrame, features: list[str], value: str, row_id: str, n_centres: int = 300) -> DataFrame:
    """Two halves of the baseline: weights should change nothing."""
    half = row_hash(row_id, 7) % 2
    marked = session.cut(base.withColumn("_half", half))
    a, b = marked.where("_half = 0").withColumn("part", F.lit("half")), marked.where("_half = 1")
    w = fit_ratio(b, a, "part", features, row_id, n_centres).weigh(a, "part", [row_id, value])
    sw = F.sum("w")
    out = w.agg(F.count(F.lit(1)).alias("n_half"), F.try_divide(F.sum(F.col("w") * F.col(value)), sw).alias("ade_iw"),
                F.try_divide(sw * sw, F.count(F.lit(1)) * F.sum(F.col("w") * F.col("w"))).alias("ess_ratio"))
    out = out.withColumn("ade_base", base.agg(F.avg(value)).scalar()).withColumn("delta", F.col("ade_iw") - F.col("ade_base"))
    return out.withColumn("calibrated", (F.abs("delta") < 0.5) & (F.col("ess_ratio") >= 0.3))


HELD_OUT = 0.2
BINS = 512
REACH = 6.0
STEPS = 25
ROWS = 4096


def _draws(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit hashes."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _pieces(batches: Iterator[pd.DataFrame], key: str, features: list[str], scaling: dict, keys: list) -> Iterator[tuple]:
    """(key, scaled rows with a leading 1, side, hashes), some thousand rows at a time; baseline rows come once per key."""
    for pdf in batches:
        for k in keys:
            part = pdf[(pdf["_y"] == 0) | (pdf[key] == k)]
            s = scaling[k]
            for lo in range(0, len(part), ROWS):
                rows = part.iloc[lo:lo + ROWS]
                x = (rows[features].to_numpy(dtype=float) - s["mean"]) / s["std"]
                yield k, np.column_stack([np.ones(len(x)), x]), rows["_y"].to_numpy(), rows["_h"].to_numpy().view(np.uint64)


def _labels(y: np.ndarray, h: np.ndarray, share: float, permutations: int) -> np.ndarray:
    """The true label and, beside it, one drawn label per permutation."""
    return np.column_stack([y, *[_draws(h, 2 * r + 3) < share for r in range(permutations)]]).astype(float)


def two_sample_classifier(
    base: DataFrame, target: DataFrame, key: str, features: list[str], row_id: str, permutations: int = 200, seed: int = 42, block: int = 32,
) -> DataFrame:
    """AUC of a logistic classifier that tells target from baseline rows, with a permutation p, over all rows.

    A fifth of the rows, chosen by hash, is held out. The fit (unit ridge penalty, free
    intercept) runs over all others: tasks add gradients and Hessians, the sums of a key are
    solved where they meet, and a step is one job. Permutations are further columns of the
    same pass: their labels are drawn with the share of the target rows from the hash of a
    row, and their steps use the Hessian of that share. ``auc`` is exact, from rank counts of
    all held-out rows; the p-value compares AUCs of scores in 512 bins, for the true labels
    and the permuted ones alike. Keys go through in blocks, so the memory of a task does not
    grow with their number. Keys whose held-out rows are of one side have AUC 0.5; rows with
    a null feature count nowhere.
    """
    kind = dict(target.dtypes)[key]
    there = F.lit(True)
    for f in features:
        there = there & F.col(f).isNotNull()
    base, target = base.where(there), target.where(there & F.col(key).isNotNull())
    scaling = pooled_scaling(base, target, key, features)
    side = lambda df, k, y: df.select(
        k.cast(kind).alias(key), F.lit(y).alias("_y"), F.xxhash64(F.lit(seed), F.lit(y), row_id).alias("_h"), *features)
    rows = session.cut(side(base, F.lit(None), 0).unionByName(side(target, F.col(key), 1)))
    names = sorted(scaling)
    results = [_classified(rows, key, kind, features, {k: scaling[k] for k in names[i:i + block]}, permutations)
               for i in range(0, len(names), block)]
    out = results[0] if results else rows.sparkSession.createDataFrame([], f"`{key}` {kind}, auc double, hits long, n_sub long")
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(key, "auc", scalars.clip((F.col("auc") - 0.5) * 200.0, 0.0, 100.0).alias("coverage_pct"),
                      (F.col("hits") / F.lit(float(permutations))).alias("p_value"), F.lit(permutations).cast("long").alias("n_permut"), "n_sub")


def _classified(rows: DataFrame, key: str, kind: str, features: list[str], scaling: dict, permutations: int) -> DataFrame:
    """(key, auc, hits, n_sub) of one block of keys."""
    keys, width, runs = list(scaling), len(features) + 1, permutations + 1
    share = {k: s["n"] / (s["n"] + s["n_base"]) for k, s in scaling.items()}
    ui, uj = np.triu_indices(width)
    beta = {k: np.zeros((width, runs)) for k in keys}
    penalty = np.diag(np.r_[1e-9, np.ones(width - 1)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for k, x, y, h in _pieces(batches, key, features, scaling, keys):
            fit = _draws(h, 1) >= HELD_OUT
            x, b = x[fit], beta[k]
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -30, 30)))
            grad = x.T @ (p - _labels(y[fit], h[fit], share[k], permutations))
            curve, plain = (x * (p[:, 0] * (1 - p[:, 0]))[:, None]).T @ x, x.T @ x
            total[k] = total.get(k, 0.0) + np.concatenate([grad.ravel(), curve[ui, uj], plain[ui, uj]])
        if total:
            yield pd.DataFrame({key: list(total), "slot": TaskContext.get().partitionId() % 32, "v": list(total.values())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: pdf[key].iloc[:1], "slot": pdf["slot"].iloc[:1], "v": [np.sum(np.stack(pdf["v"]), axis=0)]})

    def square(v: np.ndarray) -> np.ndarray:
        out = np.zeros((width, width))
        out[ui, uj] = v
        return out + np.triu(out, 1).T

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        k, v = pdf[key].iloc[0], np.sum(np.stack(pdf["v"]), axis=0)
        b, q = beta[k], len(ui)
        grad = v[:width * runs].reshape(width, runs) + np.r_[0.0, np.ones(width - 1)][:, None] * b
        step = np.empty_like(b)
        step[:, :1] = np.linalg.solve(square(v[-2 * q:-q]) + penalty, grad[:, :1])
        step[:, 1:] = np.linalg.solve(share[k] * (1 - share[k]) * square(v[-q:]) + penalty, grad[:, 1:])
        return pd.DataFrame({key: [k], "b": [(b - step).ravel()], "far": [float(max(1e5 * np.abs(step[:, 0]).max(), np.abs(step).max()))]})

    for _ in range(STEPS):
        parts = rows.mapInPandas(sums, f"`{key}` {kind}, slot int, v array<double>")
        parts = parts.groupBy(key, "slot").applyInPandas(add, f"`{key}` {kind}, slot int, v array<double>")
        solved = parts.groupBy(key).applyInPandas(move, f"`{key}` {kind}, b array<double>, far double").collect()  # one row a key of the block
        beta.update({r[key]: np.array(r["b"]).reshape(width, runs) for r in solved})
        if all(r["far"] < 1e-3 for r in solved):  # 1e-8 for the true labels
            break

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: dict = {}
        for k, x, y, h in _pieces(batches, key, features, scaling, keys):
            out = _draws(h, 1) < HELD_OUT
            b = beta[k][1:]
            z = x[out][:, 1:] @ (b / np.maximum(np.sqrt((b * b).sum(0)), 1e-300))
            cell = np.clip((z + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64) + BINS * np.arange(runs)
            one = _labels(y[out], h[out], share[k], permutations) > 0
            both = count.setdefault(k, np.zeros((2, runs * BINS), np.int64))
            both[0] += np.bincount(cell[~one], minlength=runs * BINS)
            both[1] += np.bincount(cell[one], minlength=runs * BINS)
        for k, (n0, n1) in count.items():
            at = np.flatnonzero(n0 + n1)
            yield pd.DataFrame({key: k, "run": at // BINS, "cell": at % BINS, "n0": n0[at], "n1": n1[at]})

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, x, y, h in _pieces(batches, key, features, scaling, keys):
            out = _draws(h, 1) < HELD_OUT
            yield pd.DataFrame({key: k, "score": x[out] @ beta[k][:, 0], "y": y[out]})

    cells = rows.mapInPandas(binned, f"`{key}` {kind}, run int, cell int, n0 long, n1 long").groupBy(key, "run", "cell").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    own = Window.partitionBy(key, "run")
    below = F.sum("n0").over(own.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n0")
    area = cells.withColumn("_c", F.col("n1") * (below + F.col("n0") / 2)).groupBy(key, "run").agg(
        F.coalesce(F.try_divide(F.sum("_c"), F.sum("n0") * F.sum("n1")), F.lit(0.5)).alias("area"))
    seen = area.where("run = 0").select(key, F.col("area").alias("seen"))
    hits = area.where("run > 0").join(seen, key).groupBy(key).agg(F.count_if(F.col("area") >= F.col("seen")).alias("hits"))
    counts = rows.mapInPandas(scored, f"`{key}` {kind}, score double, y long").groupBy(key, "score").agg(
        F.count_if(F.col("y") == 0).alias("_n0"), F.count_if(F.col("y") == 1).alias("_n1"))
    ranked = running(session.cut(counts), [key], ["score"], {"_below": F.col("_n0")}, {})
    auc = ranked.groupBy(key).agg(F.coalesce(F.try_divide(
        F.sum(F.col("_n1") * (F.col("_below") + F.col("_n0") / 2)), F.sum("_n0") * F.sum("_n1")), F.lit(0.5)).alias("auc"))
    sizes = rows.where("_y = 1").groupBy(key).agg(F.count(F.lit(1)).alias("n_sub"))
    out = sizes.where(F.col(key).isin(keys)).join(auc, key, "left").join(hits, key, "left")
    return session.cut(out.select(key, F.coalesce("auc", F.lit(0.5)).alias("auc"), F.coalesce("hits", F.lit(permutations)).alias("hits"), "n_sub"))
