"""Run sequential detectors over series that are split into chunks.

Every chunk is started at once from a guess: the state reached by running the
detector over the rows just before the chunk.  The guesses are then compared
with the true end states of the chunks in front.  Chunks whose guess was wrong
run again from the true state until all links agree, so alarms equal those of
one pass over the whole series while no task sees more than one chunk.  A chain
of resets is sequential by nature: detectors that never settle read the chunks of a
series one after another in one task, which keeps a chunk and the state of the detector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import smoothing
from tidemark.operators.detectors import kernels
from tidemark.operators.ordered import Series, series, with_halo
from tidemark.schema import finite

TOLERANCE = 1e-9


def _smoother(c: dict) -> tuple[str, dict]:
    kind, params = c.get("smoother") or ("none", {})
    return kind, params


def _resolve(c: dict, facts: dict) -> dict:
    """Numbers of a configuration; a callable takes the facts of the series."""
    return {k: (v(facts) if callable(v) else v) for k, v in c.items() if not k.startswith("_")}


class _Piece:
    """One chunk with its halo, as columns sorted by position; smoothed signals are shared by configurations."""

    def __init__(self, rows, idx: str, value: str, facts: list[str]):
        self.at = np.asarray(rows[idx])
        self.raw = np.asarray(rows[value], dtype=float)
        self.own = np.asarray(rows["_own"])
        self.facts = {f: np.asarray(rows[f])[0] for f in facts}
        self.stop = bool(self.at[-1] == np.asarray(rows["_end"])[0])
        self.cache: dict = {}

    def signal(self, c: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows before the chunk, rows of the chunk, their positions), smoothed."""
        kind, params = _smoother(c)
        key = (kind, tuple(sorted(params.items())))
        if key not in self.cache:
            whole = bool(self.at[0] == 0)
            smooth, before, _ = c["_smooth"]
            out = smooth(self.raw, params, whole, self.stop)
            skip = 0 if whole else before(params)
            first = int(np.argmax(self.own))
            last = first + int(self.own.sum())
            self.cache[key] = (out[min(skip, first):first], out[first:last], self.at[first:last])
        return self.cache[key]

    def run(self, c: dict, state: list[float] | None, lead: tuple[float, float]):
        p = _resolve(c, self.facts)
        kernel = c["_kernel"]
        pre, x, at = self.signal(c)
        if state is None:
            state = kernel.cold(p)
            if len(pre) and at[0] > 0:
                before = (lead[0] - len(pre), lead[1] - float(pre.sum()))
                _, state = kernel.run(p, state, pre[:0], pre, before)
        hits, stop = kernel.run(p, list(state), pre, x, lead)
        return at[hits], [float(v) for v in state], [float(v) for v in stop]


def _sorted_groups(batches: Iterator[pa.RecordBatch], group: list[str], columns: list[str]) -> Iterator[tuple[dict, dict]]:
    """(values of the group, its rows as arrays) one group at a time, from rows that come sorted by group."""
    held, key, last = [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        seen = pa.Table.from_batches([last, batch] if held else [batch]).combine_chunks()
        change = np.zeros(seen.num_rows - 1, dtype=bool)
        for g in group:
            code = seen.column(g).combine_chunks().dictionary_encode(null_encoding="encode")
            code = code.indices.to_numpy(zero_copy_only=False)
            change |= code[1:] != code[:-1]
        starts = np.flatnonzero(change) + (0 if held else 1)
        if not held:
            starts = np.concatenate([[0], starts])
        keys = batch.select(group).take(pa.array(starts, pa.int64())).to_pylist()
        arrays = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        at = 0
        for start, found in zip(starts.tolist(), keys):
            if start > at:
                held.append({c: a[at:start] for c, a in arrays.items()})
            if held:
                yield key, held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in columns}
            held, key, at = [], found, start
        held.append({c: a[at:] for c, a in arrays.items()})
        last = batch.slice(batch.num_rows - 1)
    if held:
        yield key, held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in columns}


def _same(a, b) -> F.Column:
    close = F.zip_with(a, b, lambda x, y: (x == y) | (
        F.abs(x - y) <= TOLERANCE * (1 + F.abs(x))))
    return (F.size(a) == F.size(b)) & F.forall(close, lambda ok: F.coalesce(ok, F.lit(False)))


def detect(
    s: Series,
    value: str,
    configs: list[dict],
    facts: list[str] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Alarms of every configuration on every series: keys, ``cfg``, position.

    A configuration is a dict with ``cfg`` (its name), ``detector``, the numbers
    of that detector and optionally ``smoother`` = (kind, numbers).  ``facts``
    are columns that are constant within a series; numbers may be callables that
    take them.  Rows that are not finite are passed over, as if not there.
    """
    facts = facts or []
    keys, idx = list(s.keys), s.idx
    configs = [_bound(c) for c in configs]
    spark = s.spark
    size = rows or session.chunk_rows(spark)
    pre_smoothed = all(_smoother(c)[0] == "none" for c in configs)
    if pre_smoothed and not s.df.where(~finite(value) | F.col(value).isNull()).limit(1).isEmpty():
        # positions over the usable rows; the alarm is reported at the old position
        usable = s.df.where(finite(value)).withColumnRenamed(idx, "_at")
        inner = series(usable, keys, ["_at"], idx)
        found = detect(inner, value, configs, facts, rows)
        back = inner.df.select(*keys, idx, "_at")
        return (found.join(back, [*keys, idx]).drop(idx)
                .withColumnRenamed("_at", idx).select(*keys, "cfg", idx))

    chunks = max(1, math.ceil(s.longest / size))
    walked = [c for c in configs if not c["_kernel"].settles]
    if chunks > 1 and walked:
        out, linked = _walk(s, value, walked, facts, size), [c for c in configs if c["_kernel"].settles]
        return out.unionByName(detect(s, value, linked, facts, rows)) if linked else out
    source = s.df.select(*keys, idx, value, *facts)
    if chunks > 1:
        source = session.cut(source)
    after = max(smoothing.reach(*_smoother(c))[1] for c in configs)
    if after:
        source = source.join(source.groupBy(*keys).agg(F.max(idx).alias("_end")), keys)
    else:
        source = source.withColumn("_end", F.lit(-1).cast("long"))
    before = 0
    if chunks > 1:
        before = max(smoothing.reach(*_smoother(c))[0]
                     + kernels.DETECTORS[c["detector"]].reach(_loose(c)) for c in configs)
    pieces = with_halo(s.using(source), before, after, size)
    own_chunks = F.col("_chunk") <= F.floor(F.col("_last") / size)
    if before or after:
        last = source.groupBy(*keys).agg(F.max(idx).alias("_last"))
        pieces = pieces.join(last, keys).where(own_chunks).drop("_last")

    want = max(1, math.ceil(2 * session.parallelism(spark) / max(1, s.count * chunks)))
    batches = [list(b) for b in np.array_split(np.arange(len(configs)), min(want, len(configs)))]
    pieces = pieces.withColumn("_batch", F.explode(
        F.array(*[F.lit(i) for i in range(len(batches))])))
    names = {f.name: f.dataType.simpleString() for f in s.df.schema.fields}
    key_schema = ", ".join(f"`{k}` {names[k]}" for k in keys)
    schema = (f"{key_schema}, cfg string, `_chunk` bigint, start array<double>, "
              "stop array<double>, hits array<bigint>")
    by_name = {c["cfg"]: c for c in configs}
    group = [*keys, "_chunk", "_batch"]

    def rows_of(key, results) -> pd.DataFrame:
        out = pd.DataFrame(results, columns=["cfg", "_chunk", "start", "stop", "hits"])
        for k, v in zip(keys, key[:len(keys)]):
            out[k] = v
        return out[[*keys, "cfg", "_chunk", "start", "stop", "hits"]]

    columns = list(dict.fromkeys([idx, value, "_own", "_end", *facts]))

    def whole(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kinds = [], None

        def flushed() -> pa.RecordBatch:
            counts = [len(h) for _, _, h in found]
            own = [pa.array([k[c] for k, _, _ in found], kinds[c]).take(pa.array(np.repeat(np.arange(len(found)), counts))) for c in keys]
            cfg = pa.array(np.repeat(np.array([n for _, n, _ in found], dtype=object), counts), pa.string())
            at = pa.array(np.concatenate([np.asarray(h, dtype=np.int64) for _, _, h in found]), pa.int64())
            return pa.RecordBatch.from_arrays([*own, cfg, at], [*keys, "cfg", idx])

        def noted():
            nonlocal kinds
            for b in batches_in:
                kinds = kinds or {c: b.schema.field(c).type for c in keys}
                yield b

        size_of = 0
        for key, rows in _sorted_groups(noted(), group, columns):
            piece = _Piece(rows, idx, value, facts)
            for i in batches[key["_batch"]]:
                hits, _, _ = piece.run(configs[i], None, (0.0, 0.0))
                if len(hits):
                    found.append((key, configs[i]["cfg"], hits))
                    size_of += len(hits)
            if size_of > 100_000:
                yield flushed()
                found, size_of = [], 0
        if found:
            yield flushed()

    def again(key, pdf, tasks):
        if not len(pdf) or not len(tasks):
            return rows_of(key, [])
        piece = _Piece(pdf.sort_values(idx, kind="stable"), idx, value, facts)
        chunk = int(key[len(keys)])
        done = []
        for t in tasks.itertuples(index=False):
            given = None if t.state is None else [float(v) for v in t.state]
            hits, start, stop = piece.run(by_name[t.cfg], given, (float(t.lead_n), float(t.lead_s)))
            done.append((t.cfg, chunk, start, stop, hits.tolist()))
        return rows_of(key, done)

    if chunks == 1:
        # many short series share a task and come as one sorted stream: a call a series costs more than its rows
        dealt = pieces.repartition(session.parallelism(spark), *group).sortWithinPartitions(*group, idx)
        return dealt.mapInArrow(whole, f"{key_schema}, cfg string, `{idx}` bigint")

    place = reduce(lambda acc, iv: acc.when(F.col("cfg").isin([configs[j]["cfg"] for j in iv[1]]), iv[0]),
                   enumerate(batches), F.when(F.lit(False), 0)).alias("_batch")
    lead = _leads(pieces, s, value, configs, facts, key_schema)
    tasks = lead.select(*keys, "_chunk", "cfg", place, F.lit(None).cast("array<double>").alias("state"),
                        "lead_n", "lead_s")
    lead_of = lead.select(*keys, "_chunk", "cfg", "lead_n", "lead_s")

    def run_tasks(todo: DataFrame, some: bool) -> DataFrame:
        shown = pieces
        if some:
            shown = pieces.join(todo.select(*group).distinct(), group, "left_semi")
        return shown.groupBy(*group).cogroup(todo.groupBy(*group)).applyInPandas(again, schema)

    table = session.cut(run_tasks(tasks, False))
    while True:
        ends = table.select(*keys, "cfg", (F.col("_chunk") + 1).alias("_chunk"),
                            F.col("stop").alias("state"))
        wrong = table.join(ends, [*keys, "cfg", "_chunk"]).where(~_same(F.col("start"), F.col("state")))
        todo = session.cut(wrong.select(*keys, "cfg", "_chunk", "state"))
        if todo.isEmpty():
            break
        redo = run_tasks(todo.join(lead_of, [*keys, "_chunk", "cfg"]).select(
            *keys, "_chunk", "cfg", place, "state", "lead_n", "lead_s"), True)
        table = session.cut(table.join(todo, [*keys, "cfg", "_chunk"], "left_anti").unionByName(redo))
    return table.select(*keys, "cfg", F.explode("hits").alias(idx))


def _walk(s: Series, value: str, configs: list[dict], facts: list[str], size: int) -> DataFrame:
    """Alarms of detectors that never settle, in one pass over the sorted chunks of every series.

    The rows of a series and of a batch of configurations come to one task, sorted, as a
    stream; it holds one chunk with the rows its smoothers need, and the states between chunks.
    """
    keys, idx = list(s.keys), s.idx
    reach = [smoothing.reach(*_smoother(c)) for c in configs]
    before, after = max(r[0] for r in reach), max(r[1] for r in reach)
    source = s.df.select(*keys, idx, value, *facts)
    ends = source.groupBy(*keys).agg(F.max(idx).alias("_end"))
    pieces = with_halo(s.using(source.join(ends, keys)), before, after, size)
    pieces = pieces.where(F.col("_chunk") <= F.floor(F.col("_end") / size))
    want = max(1, math.ceil(2 * session.parallelism(s.spark) / max(1, s.count)))
    batches = [list(b) for b in np.array_split(np.arange(len(configs)), min(want, len(configs)))]
    pieces = pieces.withColumn("_batch", F.explode(F.array(*[F.lit(i) for i in range(len(batches))])))
    names = {f.name: f.dataType.simpleString() for f in s.df.schema.fields}
    group = [*keys, "_batch", "_chunk"]

    def chunk_alarms(parts: list[pd.DataFrame], states: dict) -> pd.DataFrame:
        pdf = pd.concat(parts, ignore_index=True)
        piece, found = _Piece(pdf.sort_values(idx, kind="stable"), idx, value, facts), []
        for i in batches[int(pdf["_batch"].iloc[0])]:
            state, lead = states.get(i, (None, (0.0, 0.0)))
            _, x, _ = piece.signal(configs[i])
            hits, _, stop = piece.run(configs[i], state, lead)
            states[i] = (stop, (lead[0] + len(x), lead[1] + float(np.sum(x))))
            found += [(configs[i]["cfg"], int(h)) for h in hits]
        out = pd.DataFrame(found, columns=["cfg", idx])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "cfg", idx]]

    def walk(frames):
        held, at, states = [], None, {}
        for pdf in frames:
            for _, part in pdf.groupby(group, sort=False, dropna=False):
                here = [str(part[c].iloc[0]) for c in group]
                if here != at:
                    if held:
                        yield chunk_alarms(held, states)
                    if at is None or here[:-1] != at[:-1]:
                        states = {}
                    held, at = [], here
                held.append(part)
        if held:
            yield chunk_alarms(held, states)

    dealt = pieces.repartition(*[F.col(c) for c in group[:-1]]).sortWithinPartitions(*group, idx)
    return dealt.mapInPandas(walk, ", ".join(f"`{k}` {names[k]}" for k in keys) + f", cfg string, `{idx}` bigint")


def _bound(c: dict) -> dict:
    """The configuration with its kernels, as registered on the driver.

    The critical KS distance is found once here, not in every task.
    """
    kind, _ = _smoother(c)
    c = {**c, "_kernel": kernels.DETECTORS[c["detector"]], "_smooth": smoothing.SMOOTHERS[kind]}
    if c["detector"] != "recent_sample" or "step" in c:
        return c
    step = kernels.ks_critical_step(float(c["alpha"]), int(c["window_size"]), int(c["stat_size"]))
    return {**c, "step": step}


def _loose(c: dict) -> dict:
    """Configuration without series facts, enough to ask for the reach."""
    return {k: v for k, v in c.items() if not k.startswith("_") and not callable(v)}


def _leads(pieces, s, value, configs, facts, key_schema) -> DataFrame:
    """Count and sum of the smoothed rows before each chunk, per configuration."""
    keys, idx = list(s.keys), s.idx
    distinct: dict = {}
    for c in configs:
        kind, params = _smoother(c)
        distinct.setdefault((kind, tuple(sorted(params.items()))), []).append(c["cfg"])
    probes = {f"s{i}": ({"smoother": (k[0], dict(k[1])), "_smooth": smoothing.SMOOTHERS[k[0]]}, names)
              for i, (k, names) in enumerate(distinct.items())}

    def totals(key, pdf):
        piece = _Piece(pdf.sort_values(idx, kind="stable"), idx, value, facts)
        out = []
        for tag, (c, _) in probes.items():
            _, x, _ = piece.signal(c)
            out.append((tag, float(len(x)), float(np.sum(x))))
        frame = pd.DataFrame(out, columns=["tag", "n", "total"])
        for k, v in zip(keys, key[:len(keys)]):
            frame[k] = v
        frame["_chunk"] = int(key[len(keys)])
        return frame[[*keys, "_chunk", "tag", "n", "total"]]

    sums = pieces.where("_batch = 0").groupBy(*keys, "_chunk").applyInPandas(
        totals, f"{key_schema}, `_chunk` bigint, tag string, n double, total double")
    w = Window.partitionBy(*keys, "tag").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        *keys, "_chunk", "tag",
        F.coalesce(F.sum("n").over(w), F.lit(0.0)).alias("lead_n"),
        F.coalesce(F.sum("total").over(w), F.lit(0.0)).alias("lead_s"))
    named = reduce(lambda acc, kv: acc.when(F.col("tag") == kv[0], F.array(*[F.lit(n) for n in kv[1][1]])),
                   probes.items(), F.when(F.lit(False), F.array(F.lit(""))))
    return session.cut(before.withColumn("cfg", F.explode(named)).drop("tag"))
