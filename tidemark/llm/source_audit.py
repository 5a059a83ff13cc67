"""Audit of how far the sources of a language differ, by single-pass in-memory indexing.

Every task counts its documents into block postings ((lang, source), term) -> (occurrences,
documents). When a block reaches its byte budget, it is spilled as a run: sorted by term, cut
into hash shards and packed, one row a run and shard, which the shuffle carries. A shard's
runs are merged by a heap, ``FAN_IN`` runs at a time, so a task holds some packed runs and
what they add up to, never the postings of the corpus. The merge keeps the terms that enough
documents of the language hold.

A divergence of two sources sums over all kept terms, most of which neither source has. So it
starts from the value that all terms would give at count zero. A histogram of the counts of
each source corrects it for the terms that one side has, and a stream over the merged postings
corrects it once more for the terms that both have. All arithmetic is in whole numbers.

Defined results: null text, lang and source count as empty strings; a source without a term
still takes part, with count 0 everywhere; a language without a kept term gives value 0 for
each pair; repeated rows count as often as they stand there; equal values rank by the UTF-8
bytes of the item; an empty table gives no rows; further columns are ignored. Work on pairs
grows with the square of the number of sources of one language, as the report does.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attach_salted, stored
from tidemark.session import parallelism

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
#: Entries of block postings, of some 200 bytes each, before a run is spilled.
BLOCK_ENTRIES = 400_000
#: Text bytes a shard of the merge answers for.
SHARD_BYTES = 32 << 20
FAN_IN = 64
PAIRS = 2_000_000
# The class of a term over the bytes of a text whose A-Z are lower-cased, the scale of a share and its smoothing.
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE_STEPS, STEP, SMOOTH = 3, 1000, 2

PACKED = pa.schema([("group", pa.int32()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
HELD = pa.struct([("source", pa.string()), ("n", pa.int64())])
FREQUENCIES = pa.schema([("lang", pa.string()), ("term", pa.string()), ("lang_n", pa.int64()), ("held", pa.list_(HELD))])


def _packed(groups: list[tuple[str, str]], rows: pa.Table) -> bytes:
    """A sorted run of one shard with the names of its groups."""
    named = rows.replace_schema_metadata({b"groups": json.dumps(groups)}).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, named.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(named)
    return sink.getvalue().to_pybytes()


class Merge:
    """Packed runs of one shard, merged by a heap.

    Each run gives its terms in order; the heap takes the least of them. Terms that all runs together hold in fewer
    than ``least`` documents, whatever their language, are left out before: the runs are all there is of the shard then.
    Afterwards ``term`` numbers the merged ``terms``, and (term, group) ascend with their sums n and docs.
    """

    def __init__(self, runs: list[bytes], least: int = 0):
        tables = [pa.ipc.open_stream(r).read_all() for r in runs]
        named = [[tuple(g) for g in json.loads(t.schema.metadata[b"groups"])] for t in tables]
        self.groups = sorted({g for groups in named for g in groups}, key=lambda g: (g[0].encode(), g[1].encode()))
        code = {g: k for k, g in enumerate(self.groups)}
        whole = pa.concat_tables([t.replace_schema_metadata() for t in tables]).combine_chunks()
        group = np.concatenate([np.array([code[g] for g in groups], np.int64)[t["group"].to_numpy()] for groups, t in zip(named, tables)])
        n, docs, terms = whole["n"].to_numpy(), whole["docs"].to_numpy(), whole["term"].combine_chunks()
        word = terms.dictionary_encode().indices.to_numpy()
        live = np.bincount(word, docs)[word] >= least
        bounds = np.cumsum([0, *(t.num_rows for t in tables)])
        streams = [self._heads(terms, word, a + np.flatnonzero(live[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]
        self.terms, pieces, number = [], [], []
        for term, at, end in heapq.merge(*streams, key=itemgetter(0)):
            if not self.terms or self.terms[-1] != term:
                self.terms.append(term)
            pieces.append((at, end))
            number.append(len(self.terms) - 1)
        at, end = np.array(pieces, np.int64).reshape(-1, 2).T
        size = end - at
        rows = np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)
        key = np.repeat(np.array(number, np.int64), size) * len(self.groups) + group[rows]
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.term, self.group = np.divmod(key[heads], max(1, len(self.groups)))
        self.n, self.docs = (np.add.reduceat(v[rows], heads) if len(heads) else v[:0] for v in (n, docs))

    @staticmethod
    def _heads(terms: pa.Array, word: np.ndarray, rows: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
        """(term, first row, row after the last) of a run; rows of one term stand together, all live or none."""
        heads = np.flatnonzero(np.r_[True, word[rows[1:]] != word[rows[:-1]]]) if len(rows) else rows
        ends = rows[np.r_[heads[1:], len(rows)] - 1] + 1 if len(rows) else rows
        return zip(terms.take(pa.array(rows[heads])).to_pylist(), rows[heads].tolist(), ends.tolist())

    def packed(self) -> bytes:
        columns = (self.group.astype(np.int32), pa.array(self.terms, pa.binary()).take(pa.array(self.term)), self.n, self.docs)
        return _packed(self.groups, pa.table(list(map(pa.array, columns)), schema=PACKED))

    def kept(self, least: int) -> pa.RecordBatch:
        """Terms in ``least`` documents of a language with the counts of its sources."""
        names = sorted({g[0] for g in self.groups}, key=str.encode)
        of = np.array([names.index(g[0]) for g in self.groups], np.int64)[self.group]
        key = self.term * max(1, len(names)) + of
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[heads, len(key)])
        enough = (np.add.reduceat(self.docs, heads) if len(heads) else heads) >= least
        rows = np.repeat(enough, size)
        heads, size = heads[enough], size[enough]
        source = pa.array([g[1] for g in self.groups], pa.string()).take(pa.array(self.group[rows]))
        held = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)),
                                        pa.StructArray.from_arrays([source, pa.array(self.n[rows])], fields=list(HELD)))
        total = np.add.reduceat(self.n[rows], np.cumsum(size) - size) if len(size) else self.n[:0]
        columns = [pa.array(names, pa.string()).take(pa.array(of[heads])), pa.array(self.terms, pa.binary()).cast(pa.string()).take(pa.array(self.term[heads])),
                   pa.array(total), held]
        return pa.RecordBatch.from_arrays(columns, schema=FREQUENCIES)


class Block:
    """Postings of the documents read since the last spill."""

    def __init__(self, shards: int):
        self.shards, self.groups, self.entries = shards, {}, 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        terms = TERM.findall(text.lower())
        if terms:
            counts, docs = self.groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(docs)
            counts.update(terms)
            docs.update(set(terms))
            self.entries += len(docs) - before

    def spill(self) -> Iterator[tuple[int, bytes]]:
        """(shard, packed run) of all postings, each sorted by term; the block is empty then."""
        names, terms, n, docs, group = list(self.groups), [], [], [], []
        for code, key in enumerate(names):
            counts, held = self.groups[key]
            terms += counts.keys()
            n += counts.values()
            docs += map(held.__getitem__, counts)
            group.append(np.full(len(counts), code, np.int32))
        self.groups, self.entries = {}, 0
        if not terms:
            return
        shard = np.fromiter((crc32(t) % self.shards for t in terms), np.int32, len(terms))
        table = pa.table({"group": np.concatenate(group), "term": pa.array(terms, pa.binary()), "n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.int64())})
        by_term = pc.sort_indices(table["term"]).to_numpy()
        order = by_term[np.argsort(shard[by_term], kind="stable")]
        table, shard = table.take(pa.array(order)), shard[order]
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(shard[a]), _packed(names, table.slice(a, b - a))


def _runs(shards: int, entries: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, task, k = Block(shards), TaskContext.get().partitionId(), 0

        def rows() -> Iterator[pa.RecordBatch]:
            for shard, data in block.spill():
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([task << 24 | k], pa.int64()), pa.array([data], pa.binary())], ["shard", "run", "data"])

        for batch in batches:
            lang, source = batch["lang"].to_pylist(), batch["source"].to_pylist()
            for at, text in enumerate(batch["text"].cast(pa.binary())):
                block.add(lang[at], source[at], text.as_py())
                if block.entries >= entries:
                    yield from rows()
                    k += 1
        yield from rows()

    return index


def _merged(least: int, fan_in: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = ((r, d.as_py()) for b in batches for r, d in zip(b["shard"].to_pylist(), b["data"]))
        for _, rows in groupby(packed, itemgetter(0)):
            levels: list[list[bytes]] = [[]]  # runs merged once, twice, ... wait for their like
            for _, data in rows:
                levels[0].append(data)
                for up in range(len(levels)):
                    if len(levels[up]) >= fan_in:
                        if up + 1 == len(levels):
                            levels.append([])
                        levels[up + 1].append(Merge(levels[up]).packed())
                        levels[up] = []
            yield Merge([r for level in levels for r in level], least).kept(least)

    return merge


def frequencies(docs: DataFrame, least: int = LEAST_DOCUMENTS, entries: int = BLOCK_ENTRIES, shard_bytes: int = SHARD_BYTES,
                fan_in: int = FAN_IN) -> DataFrame:
    """(lang, term, lang_n, held: [(source, n)] by source) of the terms in at least ``least`` documents of a language."""
    spark = docs.sparkSession
    named = _named(docs)
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(parallelism(spark), -(-size // shard_bytes))
    runs = named.mapInArrow(_runs(shards, entries), "shard int, run long, data binary")
    dealt = runs.repartition(shards, "shard").sortWithinPartitions("shard", "run")
    return dealt.mapInArrow(_merged(least, fan_in), "lang string, term string, lang_n long, held array<struct<source:string,n:long>>")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 (n + 2) / total), by long division so that no product leaves 64 bits."""
    out, rest = F.lit(0).cast("long"), n + SMOOTH
    for _ in range(SCALE_STEPS):
        out, rest = out * STEP + _div(rest * STEP, total), (rest * STEP) % total
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def group_table(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, vocabulary, total, lang_total, zero) of every occurring source; the last three are null
    where the language keeps no term."""
    named = _named(docs).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
    of_lang = found.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("lang_n").alias("lang_n"))
    of_source = found.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    joined = named.join(of_lang, "lang", "left").join(of_source, ["lang", "source"], "left")
    smooth = SMOOTH * F.col("vocabulary")
    total = F.coalesce("n", F.lit(0)) + smooth
    return joined.select("lang", "source", F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"), total.alias("total"),
                         (F.col("lang_n") + smooth).alias("lang_total"), share(F.lit(0).cast("long"), total).alias("zero"))


def top_terms(postings: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """The terms by which a source exceeds its language most."""
    q = share(F.col("lang_n"), F.col("lang_total"))
    over = postings.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).where("p > q")
    valued = over.select("lang", "source", F.lit("term").alias("part"), "item", gap(F.col("p"), F.col("q")).alias("value"))
    return _ranked(valued).where(F.col("rank") <= most)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value): corrections for terms that both sources have, summed over what the task reads."""
    names: dict = {}
    sums: dict[int, int] = {}

    def rows() -> pa.RecordBatch:
        key, known = np.fromiter(sums, np.int64, len(sums)), list(names)
        a, b = [known[k] for k in key >> 32], [known[k] for k in key & 0xFFFFFFFF]
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in a], pa.string()), pa.array([g[1] for g in a], pa.string()),
                                           pa.array([g[1] for g in b], pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "a", "b", "value"])

    for batch in batches:
        held = batch["held"]
        sizes = pc.list_value_length(held).to_numpy()
        flat = held.flatten()
        langs = np.repeat(np.array(batch["lang"].to_pylist(), object), sizes)
        code = np.fromiter((names.setdefault(g, len(names)) for g in zip(langs, flat.field("source").to_pylist())), np.int64, len(langs))
        p, zero = flat.field("p").to_numpy(), flat.field("zero").to_numpy()
        partners = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code)) - 1
        upto = np.cumsum(partners)
        at = 0
        while at < len(code):  # postings with about PAIRS partners at a time
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            left = np.repeat(np.arange(at, end), partners[at:end])
            right = left + 1 + np.arange(len(left)) - np.repeat(upto[at:end] - partners[at:end] - (upto[at - 1] if at else 0), partners[at:end])
            value = _gap(p[left], p[right]) - _gap(p[left], zero[right]) - _gap(zero[left], p[right]) + _gap(zero[left], zero[right])
            key = code[left] << 32 | code[right]
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            for k, v in zip(key[heads].tolist(), np.add.reduceat(value, heads).tolist() if len(key) else []):
                sums[k] = sums.get(k, 0) + v
            if len(sums) > PAIRS:
                yield rows()
                sums.clear()
            at = end
    if sums:
        yield rows()


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    left = groups.select("lang", F.col("source").alias("a"), "vocabulary", F.col("zero").alias("z_a"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("z_b"))
    plain = left.join(other, "lang").where("a < b").select(
        "lang", "a", "b", F.coalesce(F.col("vocabulary") * gap(F.col("z_a"), F.col("z_b")), F.lit(0)).alias("value"))
    counts = postings.groupBy("lang", F.col("source").alias("a"), "p", F.col("zero").alias("z_a")).agg(F.count(F.lit(1)).alias("terms"))
    moved = F.col("terms") * (gap(F.col("p"), F.col("z_b")) - gap(F.col("z_a"), F.col("z_b")))
    one = counts.join(other, "lang").where("a <> b").select("lang", F.least("a", "b").alias("a1"), F.greatest("a", "b").alias("b1"), moved.alias("value"))
    held = F.array_sort(F.collect_list(F.struct("source", "p", "zero"))).alias("held")
    both = postings.groupBy("lang", "term").agg(held).drop("term").mapInArrow(_shared_terms, "lang string, a string, b string, value long")
    summed = plain.unionByName(one.withColumnsRenamed({"a1": "a", "b1": "b"})).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return summed.select("lang", F.inline(ends), "value")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = TOP_TERMS, **indexing) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source by divergence, and the terms that stand out most."""
    found = stored(frequencies(docs, least, **indexing), "audit-frequencies")
    groups = stored(group_table(docs, found), "audit-groups")
    posts = found.select("lang", "term", "lang_n", F.inline("held"))
    known = attach_salted(posts, groups, ["lang", "source"], F.col("term"))
    postings = known.withColumn("p", share(F.col("n"), F.col("total")))
    pairs = _ranked(pair_values(postings, groups).withColumn("part", F.lit("pair")))
    return pairs.unionByName(top_terms(postings, most)).select("lang", "source", "part", "item", "value", "rank")


def audit_table(docs: DataFrame) -> DataFrame:
    return divergence(docs)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang)
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM s),
p AS (SELECT sized.*, 1 + (1000000000 * (n + 2)::HUGEINT) // (total + 2 * v) AS p, 1 + (1000000000 * (lang_n + 2)::HUGEINT) // (lang_total + 2 * v) AS q
      FROM sized JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(pairs.value, 0) AS value
          FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source),
over AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM every UNION ALL SELECT * FROM over))
SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 10
"""
