"""Studies composed of detectors, gates and evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import scalars
from tidemark.functions.hashing import uniform
from tidemark.operators import gates
from tidemark.operators.detectors import kernels
from tidemark.operators.detectors.linked import _bound as bound_config
from tidemark.operators.detectors.linked import detect
from tidemark.operators.evaluate import evaluate, games_per_period, latency, with_wilson
from tidemark.operators.ordered import Series, series
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.rankings import winners
from tidemark.operators.sampling import game_folds, packed_permutations, packed_series, permuted, permuted_array

HELD = 1 << 24  # rows of a series that a task may hold to permute them
TASKS = 4  # tasks for each core that permute series


def fold_streams(df: DataFrame, keys: list[str], fold: str, order: list[str], period="year", game="match_id") -> dict[str, Series]:
    """Calibration and test series: every other game, re-indexed."""
    split = game_folds(df, period, game, fold)
    marked = session.cut(df.join(split, [period, game]))
    return {p: series(marked.where(F.col("split") == p).drop("split"), keys, order) for p in ("calib", "test")}


def hold_out(
    df: DataFrame, keys: list[str], value: str, configs: list[dict], base: int, post: list[int], fold: str,
    order: list[str], limit: float = 0.20, game: str = "match_id",
) -> tuple[DataFrame, DataFrame]:
    """Choose a configuration per series on half of the games, judge it on the rest.

    Returns the test metrics of the chosen configurations and their latencies.
    """
    used_columns = dict.fromkeys([*keys, value, *order, "year", game])
    parts = fold_streams(df.select(*used_columns), keys, fold, order, game=game)
    names = [c["cfg"] for c in configs]
    calib = evaluate(detect(parts["calib"], value, configs), parts["calib"], names, base, post)
    # one row per series, written once so that the grid does not run again
    best = session.cut(winners(calib, keys, ["cfg"], limit).select(
        *keys, "cfg", F.col("far_per_1k").alias("far_calib"), F.col("year_coverage").alias("cov_calib")))
    # the names are bounded by the grid, however many series there are
    used = sorted(r["cfg"] for r in best.select("cfg").distinct().collect())
    alarms = detect(parts["test"], value, [c for c in configs if c["cfg"] in used])
    alarms = alarms.join(best.select(*keys, "cfg"), [*keys, "cfg"], "left_semi")
    scored = evaluate(alarms, parts["test"], used, base, post).join(best, [*keys, "cfg"])
    games = games_per_period(parts["test"].df, keys, "year", game)
    late = latency(alarms, parts["test"], used, post, games).join(best.select(*keys, "cfg"), [*keys, "cfg"], "left_semi")
    return with_wilson(scored).withColumn("fold", F.lit(fold)), late.withColumn("fold", F.lit(fold))


def stored_alarms(s: Series, value: str, stored: DataFrame, text: str, smoother) -> DataFrame:
    """Alarms of configurations kept as text, one per series."""
    rows = stored.select(text).distinct().select(
        text, *[scalars.config_value(F.col(text), n).alias(n) for n in ("delta", "mw", "cd", "xw")]).collect()
    configs = [{"cfg": r[text], "detector": "mean_split", "smoother": smoother, "delta": r["delta"], "min_window": int(r["mw"]),
                "cooldown": int(r["cd"]), "max_window": int(r["xw"])} for r in rows]
    hits = detect(s, value, configs)
    return hits.join(stored.withColumnRenamed(text, "cfg"), [*s.keys, "cfg"], "left_semi")


class _Walk:
    """A detector that reads one series chunk by chunk: its alarms, its state and the rows it may look back on."""

    def __init__(self, config: dict):
        self.kernel = kernels.DETECTORS[config["detector"]]
        bound = bound_config(config)
        self.numbers = {k: (v({}) if callable(v) else v) for k, v in bound.items() if not k.startswith("_")}
        self.back = self.kernel.reach(self.numbers) if self.kernel.settles else 0
        self.begin()

    def begin(self) -> None:
        self.k, self.state, self.before, self.lead = 0, None, np.zeros(0), (0.0, 0.0)

    def read(self, x: np.ndarray) -> None:
        x = x[np.isfinite(x)]
        if len(x):
            hits, end = self.kernel.run(self.numbers, list(self.state or self.kernel.cold(self.numbers)), self.before, x, self.lead)
            self.k, self.state = self.k + len(hits), [float(v) for v in end]
            self.lead = (self.lead[0] + len(x), self.lead[1] + float(x.sum()))
            self.before = np.concatenate([self.before, x])[-self.back:] if self.back else self.before


def permuted_alarms(s: Series, value: str, config: dict, scheme: str, block: str, reps: int) -> DataFrame:
    """Alarms (``_k``) of one configuration on every permuted series that has any.

    Without a smoother a task holds the values of a series, permutes them for its share of the replicates and reads them
    in chunks, so no replicate is ever stored or shuffled. Series above HELD rows come packed for every replicate, and a
    task reads their chunks in order; it keeps one chunk, the state of the detector and the rows before that it may look
    back on. Rows that are not finite are passed over.
    """
    if (config.get("smoother") or ("none", {}))[0] != "none":
        return detect(permuted(s, scheme, block, reps), value, [config]).groupBy(*s.keys, "rep").agg(F.count(F.lit(1)).alias("_k"))
    deal = _permuted_in_tasks if s.longest <= HELD else _permuted_in_packs
    return deal(s, value, config, scheme, block, reps).where("_k > 0")


def _counted(rows: list[tuple], schema: pa.Schema, group: list[str]) -> pa.RecordBatch:
    kinds = [*(schema.field(c).type if c != "rep" else pa.int32() for c in group), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], [*group, "_k"])


def _counted_kind(s: Series) -> str:
    names = {f.name: f.dataType.simpleString() for f in s.df.schema.fields}
    return ", ".join(f"`{c}` {names[c]}" for c in s.keys) + ", rep int, `_k` bigint"


def _permuted_in_tasks(s: Series, value: str, config: dict, scheme: str, block: str, reps: int) -> DataFrame:
    keys, size = list(s.keys), session.chunk_rows(s.spark)
    tasks = TASKS * s.spark.sparkContext.defaultParallelism
    parts = min(reps, max(1, -(-tasks // max(1, s.count))))
    group = [*keys, "_part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, schema = None, [], None
        for batch in batches:
            schema = batch.schema
            for i in range(batch.num_rows):
                now = tuple(batch.column(c)[i].as_py() for c in group)
                if held and now != here:
                    yield _counted(alarms(here, held), schema, [*keys, "rep"])
                    held = []
                here = now
                held.append([batch.column(c)[i] for c in ("_from", "_m", "_rank", "_values")])
        if held:
            yield _counted(alarms(here, held), schema, [*keys, "rep"])

    def alarms(here: tuple, held: list) -> list[tuple]:
        runs = [(f.as_py(), v.values.to_numpy(zero_copy_only=False)) for f, m, _, v in held if not m.is_valid]
        blocks = np.array(sorted([f.as_py(), m.as_py(), r.as_py()] for f, m, r, _ in held if m.is_valid), np.int64).reshape(-1, 3)
        x = np.full(max([0, *(f + len(v) for f, v in runs), *blocks[:, :2].sum(axis=1).tolist()]), np.nan)
        for f, v in runs:
            x[f:f + len(v)] = v
        held.clear()
        walk, found = _Walk(config), []
        for rep in range(here[-1], reps, parts):
            y = permuted_array(x, blocks, scheme, rep)
            walk.begin()
            for a in range(0, len(y), size):
                walk.read(y[a:a + size])
            found.append((*here[:-1], rep, walk.k))
        return found

    rows = packed_series(s, value, scheme, block).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    if parts > 1:  # few series: one task for each part
        numbers = s.df.select(*keys).distinct().withColumn("_task", F.row_number().over(Window.orderBy(*keys)) - 1)
        rows = rows.join(F.broadcast(numbers), keys)
        rows = rows.repartitionById(s.count * parts, (F.col("_task") * parts + F.col("_part")).cast("int")).drop("_task")
    else:
        rows = rows.repartition(session.parallelism(s.spark), *keys)
    return rows.sortWithinPartitions(*group).mapInArrow(run, _counted_kind(s))


def _permuted_in_packs(s: Series, value: str, config: dict, scheme: str, block: str, reps: int) -> DataFrame:
    keys, size = list(s.keys), session.chunk_rows(s.spark)
    group = [*keys, "rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, chunk, parts, walk = None, None, [], _Walk(config)

        def close() -> None:
            nonlocal parts
            if not parts:
                return
            x = np.full(1 + max(int(at.max()) for at, _ in parts), np.nan)
            for at, v in parts:
                x[at] = v
            parts = []
            walk.read(x)

        schema = None
        for batch in batches:
            schema, done = batch.schema, []
            for i in range(batch.num_rows):
                now = tuple(batch.column(c)[i].as_py() for c in group)
                at = batch.column("chunk")[i].as_py()
                if now != here or at != chunk:
                    close()
                    if now != here:
                        if here is not None:
                            done.append((*here, walk.k))
                        walk.begin()
                    here, chunk = now, at
                parts.append((np.frombuffer(batch.column("at")[i].as_py(), np.int32), np.frombuffer(batch.column("x")[i].as_py())))
            yield _counted(done, schema, group)
        if here is not None:
            close()
            yield _counted([(*here, walk.k)], schema, group)

    packed = packed_permutations(s, value, scheme, block, reps, size)
    dealt = packed.repartition(session.parallelism(s.spark), *group).sortWithinPartitions(*group, "chunk")
    return dealt.mapInArrow(run, _counted_kind(s))


def observed_alarms(df: DataFrame, keys: list[str], value: str, config: dict, block: str, order: list[str]) -> tuple[Series, DataFrame]:
    """The series, stored with the columns that permutations need, and their alarm counts."""
    real = series(df.select(*dict.fromkeys([*keys, value, block, *order])), keys, order)
    real = real.using(session.cut(real.df.select(*dict.fromkeys([*keys, value, block]), real.idx)))
    return real, session.cut(detect(real, value, [config]).groupBy(*keys).agg(F.count(F.lit(1)).alias("k_obs")))


def permutation_null(
    df: DataFrame, keys: list[str], value: str, config: dict, reps: int, scheme: str, block: str, order: list[str],
    found: tuple[Series, DataFrame] | None = None,
) -> DataFrame:
    """Alarm counts of permuted series against the observed count, per series.

    A replicate is a further key, so all replicates run at once. ``found`` are the ``observed_alarms`` if they are known.
    """
    real, observed = found or observed_alarms(df, keys, value, config, block, order)
    counts = session.cut(permuted_alarms(real, value, config, scheme, block, reps)).withColumnRenamed("_k", "k")
    every = real.df.select(*keys).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    counts = every.join(counts, [*keys, "rep"], "left").join(observed, keys, "left").fillna(0, ["k", "k_obs"])
    q = exact_quantiles(counts, keys, "k", [0.05, 0.5, 0.95])
    out = counts.groupBy(*keys).agg(
        F.max("k_obs").alias("k_obs"), F.avg("k").alias("k_mean"), F.avg((F.col("k") >= F.col("k_obs")).cast("double")).alias("p_value"))
    return out.join(q, keys).select(
        *keys, F.lit(scheme).alias("scheme"), "k_obs", "k_mean", F.col("q")[0].alias("k_p5"), F.col("q")[1].alias("k_median"),
        F.col("q")[2].alias("k_p95"), "p_value")


def resampled(base: Series, value: str, reps: int, length: int, block: int, shift: float = 0.0, at: int | None = None) -> Series:
    """Replicates of the baseline, drawn in blocks of consecutive rows.

    Slot j of a replicate takes row (start of its block + offset).  After ``at``
    rows the values are raised by ``shift`` standard deviations.
    """
    keys, idx = base.keys, base.idx
    stats = base.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop(value).alias("_sd"))
    slots = stats.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn(
        "slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(length - 1).cast("bigint"))))
    u = uniform(F.floor(F.col("slot") / block) + 1, F.col("rep"))
    start = F.floor(u * F.greatest(F.col("_n") - block + 1, F.lit(1)))
    slots = slots.withColumn(idx, (start + F.col("slot") % block) % F.col("_n"))
    drawn = slots.join(base.df.select(*keys, idx, value), [*keys, idx])
    raised = F.col(value) + F.when(F.col("slot") >= (length if at is None else at), shift * F.col("_sd")).otherwise(0.0)
    out = drawn.select(*keys, "rep", "slot", raised.alias(value))
    return Series(out, [*keys, "rep"], "slot", base.count * reps, length)


def run_lengths(base: Series, value: str, configs: list[dict], reps: int, length: int, block: int, target: float) -> DataFrame:
    """Mean rows to the first alarm without a change, and the parameter nearest the target."""
    s = resampled(base, value, reps, length, block)
    first = detect(s, value, configs).groupBy(*s.keys, "cfg").agg(F.min("slot").alias("_first"))
    every = base.df.select(*base.keys).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn(
        "cfg", F.explode(F.array(*[F.lit(c["cfg"]) for c in configs])))
    run = every.join(first, [*s.keys, "cfg"], "left").withColumn("run", F.coalesce(F.col("_first") + 1, F.lit(length)))
    arl = run.groupBy(*base.keys, "cfg").agg(F.avg("run").alias("arl")).withColumn("abs_diff", F.abs(F.col("arl") - target))
    best = arl.groupBy(*base.keys).agg(F.min_by("cfg", F.struct("abs_diff", "cfg")).alias("best"))
    return arl.join(best, base.keys).withColumn("chosen", F.col("cfg") == F.col("best")).drop("best")


def shift_delays(base: Series, value: str, configs: list[dict], shifts: list[float], reps: int, at: int, after: int, block: int) -> DataFrame:
    """Delay quantiles of each detector after a jump of k standard deviations."""
    out = None
    for k in shifts:
        s = resampled(base, value, reps, at + after, block, k, at)
        hits = detect(s, value, configs).where(F.col("slot") >= at)
        first = hits.groupBy(*s.keys, "cfg").agg((F.min("slot") - at + 1).alias("delay"))
        q = exact_quantiles(first, [*base.keys, "cfg"], "delay", [0.1, 0.5, 0.9])
        part = q.select(*base.keys, "cfg", F.lit(float(k)).alias("shift"), F.col("n").alias("n_detected"),
                        F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))
        out = part if out is None else out.unionByName(part)
    return out


def same_scale(
    s: Series, error: str, feature: str, error_config: dict, feature_configs: list[dict], widths: list[int], debounce: int,
    base: int, post: list[int], limit: float = 0.20,
) -> DataFrame:
    """Error detector and best feature detector on one axis, joined by both gates."""
    keys = s.keys
    a = detect(s, error, [error_config]).drop("cfg")
    names = [c["cfg"] for c in feature_configs]
    found = detect(s, feature, feature_configs)
    a, found = session.cut(a), session.cut(found)
    best = session.cut(winners(evaluate(found, s, names, base, post), keys, ["cfg"], limit).select(*keys, "cfg"))
    b = found.join(best, [*keys, "cfg"], "left_semi").drop("cfg")
    label = lambda df, gate: df.select(*keys, F.concat(F.lit(f"{gate}@"), F.col("W").cast("string")).alias("cfg"), s.idx)
    parts = label(gates.and_gate(a, b, keys, widths, debounce), "queue").unionByName(
        label(gates.nearest_gate(a, b, keys, widths, debounce), "nearest"))
    single = lambda df, n: df.select(*keys, F.lit(n).alias("cfg"), s.idx)
    parts = parts.unionByName(single(gates.or_gate(a, b, keys), "or")).unionByName(single(a, "error")).unionByName(single(b, "feature"))
    every = [f"{g}@{w}" for g in ("queue", "nearest") for w in widths] + ["or", "error", "feature"]
    return evaluate(parts, s, every, base, post)
