"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are summed over the distinct texts of the whole corpus.
   Words weigh log(texts / frequency). Above a frequency of STOP the weight stays what it is there,
   for words of items, and is 0 for words that no item has.
2. A randomised SVD of TF-IDF passages gives the latent space: block power iterations over all passages of
   all distinct texts and of every benchmark item, read from stored word hashes. A text that n rows have counts one
   n-th in each. Tasks send sums of projected blocks, with 16 bits a number and a factor a word.
3. Every text is projected window by window; windows have the lengths of the items, to the next of
   steps of sqrt(2), and overlap by three quarters. Windows with a cosine of at least COSINE to an item
   are candidates.
4. A candidate, with the longest item of its window's length on both sides, is a leak if its longest common
   subsequence with the item covers NEAR of the item's words, or LOOSE of them and ANSWER
   of those of its last sentence. Every candidate is checked, or an item around it lies inside one that is.
   Regions with too few of an item's words for that, whatever their order, are passed over.

Items are searched in blocks of BLOCK_ITEMS, each with one pass over the texts, so what is
sent to the tasks is bounded. Results: null and empty texts have no leaks and null items are
not searched, nor are items without a word; repeated rows have equal leaks; an item
found several times in a text is given once, with its best match; empty tables give no
rows; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, stored

BUCKETS = 1 << 17
STOP, FLOOR = 0.05, 0.5
SAMPLE = 2000  # texts that the space was once fitted on; a test goes beyond it
PASSAGE = 16
RANK, EXTRA, ROUNDS = 96, 8, 3
PART = 1 << 22  # distinct words of texts for each task of a round: what a task sends is no more than it reads
ROWS = 2048  # vocabulary rows that are summed together
TOKENS, CELL = 1 << 18, 4096  # words that a task multiplies at once, and rows that it adds up at once
COSINE, NEAR, LOOSE, ANSWER = 0.6, 0.8, 0.55, 0.6
SHORTEST = 8  # words of a window
BLOCK_ITEMS = 2000
CHUNK = 8192
TOGETHER, WORDS, TEXTS = 1 << 17, 1 << 14, 256  # bytes, words and number of short texts that are worked on at once
LEAD = 16  # windows that are looked at before one in which an item may be
CELLS = 1 << 18  # regions, or chunks, times items that are bounded at once

LEAKS = "array<struct<item_id:bigint,cosine:double,overlap:double,answer:double,first:int,last:int>>"
#: ASCII other than letters and digits separates words.
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Odd multipliers of the word hash, and the longest piece of text that is hashed at once.
_BASE, _MIX, _PIECE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 1 << 20


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def _bytes(text: str) -> bytes:
    """The words of a text in lower case between spaces."""
    return text.lower().encode("utf-8", "replace").translate(_SPLIT)


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and first byte of every word, from running sums over the bytes: a word gives the same
    number wherever it stands. Pieces of very long data are cut at a space where there is one."""
    out, places, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = len(data) if len(data) - at <= _PIECE else data.rfind(b" ", at + 1, at + _PIECE) + 1 or at + _PIECE
        piece = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.diff(np.concatenate([[False], piece != 32, [False]]).view(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers(1 << max(14, (len(piece) - 1).bit_length()))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * power[:len(piece)], out=sums[1:])
        words = (sums[last] - sums[first]) * inverse[first]
        words ^= words >> np.uint64(29)
        out.append((words * np.uint64(_MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
        places.append(first + at)
        at = end
    return np.concatenate(out), np.concatenate(places)


def buckets_of(text: str) -> np.ndarray:
    """Hash bucket of every word of a text."""
    return _hashed(_bytes(text))[0]


def buckets_of_all(texts: list[str]) -> Iterator[np.ndarray]:
    """The same for several texts, hashed together where they are short."""
    data, size = [], 0
    for k, text in enumerate(texts):
        data.append(_bytes(text))
        size += len(data[-1]) + 1
        if size > TOGETHER or k + 1 == len(texts):
            ids, first = _hashed(b" ".join(data))
            ends = np.cumsum([len(d) + 1 for d in data])
            yield from np.split(ids, np.searchsorted(first, ends[:-1]))
            data, size = [], 0


# ---- corpus statistics


def packed(ids: np.ndarray) -> bytes:
    """Buckets with 17 bits each: all lower halves, then all upper bits."""
    return ids.astype(np.uint16).tobytes() + np.packbits(ids >= 1 << 16).tobytes()


def unpacked(data) -> np.ndarray:
    n = len(data) * 8 // 17
    out = np.frombuffer(data, np.uint16, n).astype(np.int64)
    out += np.unpackbits(np.frombuffer(data, np.uint8, offset=2 * n), count=n).astype(np.int64) << 16
    return out


def hashed(docs: DataFrame) -> DataFrame:
    """(copies, sizes, words) of some texts a row, stored: how many rows have each text, its number of words, and the packed
    buckets of all their words. Only hashes of texts are shuffled."""
    mark = F.xxhash64("text")
    copies = stored(docs.groupBy(mark.alias("_mark")).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1"), "latent-copies")
    texts = attach(docs.select("text", mark.alias("_mark")), copies, "_mark", "left").select("text", F.coalesce("_copies", F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                n, held = part.column(1).to_numpy(), []
                for k, ids in enumerate(buckets_of_all([t or "" for t in part.column(0).to_pylist()]), 1):
                    held.append(ids)
                    if k == len(n) or sum(map(len, held)) > TOKENS:
                        columns = [[n[k - len(held):k]], [[len(h) for h in held]], [packed(np.concatenate(held))]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["copies", "sizes", "words"])
                        held = []

    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    return stored(texts.mapInArrow(run, "copies array<bigint>, sizes array<int>, words binary"), "latent-words")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for copies, sizes, words in zip(batch.column("copies"), batch.column("sizes"), batch.column("words")):
            yield copies.values.to_numpy(), sizes.values.to_numpy(), unpacked(words.as_buffer())


def counted(words: DataFrame) -> tuple[int, np.ndarray]:
    """Number of distinct texts and of those with each bucket; every task sends its own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(BUCKETS), 0.0
        for copies, sizes, words in _rows(batches):
            rows += (1 / copies).sum()
            for n, ids in zip(copies.tolist(), np.split(words, np.cumsum(sizes)[:-1])):
                found[ids] += 1 / n  # a bucket counts once, however often it is among the words
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(found[used], rows))], ["bucket", "n"])

    sums = words.mapInArrow(run, "bucket long, n double").groupBy("bucket").agg(F.round(F.sum("n")).cast("long").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return int(out[-1]), out[:-1]


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of distinct texts and of those with each bucket."""
    return counted(hashed(docs))


def weigh(rows: int, found: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Weights of the buckets; 0 for frequent words other than those ``asked`` for."""
    most = max(STOP * rows, 1)
    weights = np.maximum(np.log((1 + rows) / (1 + np.minimum(found, most))), FLOOR)
    return np.where((found > most) & ~asked, 0.0, weights).astype(np.float32)


# ---- the latent space


def _coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with 16 bits a number, and the factor of each row."""
    most = np.abs(rows).max(axis=1, initial=0.0)
    factor = (np.where(most > 0, most, 1.0) / 32767).astype(np.float32)
    return np.rint(rows / factor[:, None]).astype(np.int16), factor


def _decoded(codes: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return codes * factor[:, None]


def _passages(batches: Iterator[pa.RecordBatch], place: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Passages of up to TOKENS words at a time: the places of their words in runs of PASSAGE, 0 behind the end of a
    text, and what squares of their projections count: the share of the text over the squared length of the TF-IDF row."""
    held, n, squares = [], 0, weights ** 2

    def together() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, sizes, copies = map(np.concatenate, zip(*held))
        rows = -(-sizes // PASSAGE)
        ids = np.zeros((int(rows.sum()), PASSAGE), np.int32)
        ids.reshape(-1)[_ranges((np.cumsum(rows) - rows) * PASSAGE, sizes)[1]] = at
        shares = np.repeat(1 / copies, rows).astype(np.float32)
        for a in range(0, len(ids), TOKENS // PASSAGE):
            some = ids[a:a + TOKENS // PASSAGE]
            turned = np.ascontiguousarray(some.T)
            times = np.ones(turned.shape, np.uint8)
            for d in range(1, PASSAGE):
                same = (turned[d:] == turned[:-d]).view(np.uint8)
                times[d:] += same
                times[:-d] += same
            yield some.astype(np.int64), shares[a:a + len(some)] / (squares[turned] * times).sum(axis=0)

    for copies, sizes, words in _rows(batches):
        at = place[words]
        own = np.repeat(np.arange(len(sizes)), sizes)[at > 0]
        held.append((at[at > 0], np.bincount(own, minlength=len(sizes)), copies))
        n += len(own)
        if n >= TOKENS // 2:
            yield from together()
            held, n = [], 0
    if held:
        yield from together()


def _sums(basis: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The sum of the rows of basis for every row of ids."""
    out, one = np.empty((len(ids), basis.shape[1]), np.float32), np.ones((1, ids.shape[1]), np.float32)
    step = max(1, CELL // ids.shape[1])
    held = np.empty((step * ids.shape[1], basis.shape[1]), np.float32)
    for a in range(0, len(ids), step):
        at = ids[a:a + step].reshape(-1)
        np.take(basis, at, axis=0, out=held[:len(at)], mode="clip")
        np.matmul(one, held[:len(at)].reshape(-1, ids.shape[1], basis.shape[1]), out=out[a:a + step, None])
    return out


def _add(total: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Adds row p of rows to total[w] for every w in ids[p], 0 left out: words that stand equally often go together."""
    shift = ids.size.bit_length()
    key = np.sort(ids.reshape(-1) << shift | np.arange(ids.size))
    key = key[np.searchsorted(key, 1 << shift):]
    row, word = (key & (1 << shift) - 1) // ids.shape[1], key >> shift
    start = np.flatnonzero(np.diff(word, prepend=-1))
    times = np.diff(start, append=len(word))
    order = np.argsort(times, kind="stable")
    first = np.flatnonzero(np.diff(times[order], prepend=0))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        n = int(times[order[a]])
        step, piece = max(1, CELL // n), min(n, CELL)
        for x in range(a, b, step):
            some = order[x:min(b, x + step)]
            for y in range(0, n, piece):
                k = min(piece, n - y)
                held = np.take(rows, row[start[some][:, None] + np.arange(y, y + k)].reshape(-1), axis=0)
                total[word[start[some]]] += np.matmul(np.ones((1, k), np.float32), held.reshape(len(some), k, -1))[:, 0]


def _multiplied(words: DataFrame, tasks: int, place: np.ndarray, weights: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A'A times the basis, for the rows A of normalised TF-IDF passages: one pass, summed by blocks of the vocabulary, coded."""
    sent = words.sparkSession.sparkContext.broadcast((place, weights, codes, factor))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weights, codes, factor = sent.value
        basis = np.concatenate([np.zeros((1, codes.shape[1]), np.float32), _decoded(codes, factor * weights[1:])])
        total = np.zeros_like(basis)
        for ids, share in _passages(batches, place, weights):
            _add(total, ids, _sums(basis, ids) * share[:, None])
        del basis
        for b in range(0, len(factor), ROWS):
            yield part(b // ROWS, total[1 + b:1 + b + ROWS] * weights[1 + b:1 + b + ROWS, None])

    def part(block: int, rows: np.ndarray) -> pa.RecordBatch:
        codes, factor = _coded(rows)
        columns = [pa.array([block], pa.int32()), pa.array([codes.tobytes()], pa.binary()), pa.array([factor.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "codes", "factor"])

    def rows_of(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for c, f in zip(table["codes"], table["factor"]):
            yield np.frombuffer(c.as_buffer(), np.int16).reshape(len(f.as_buffer()) // 4, -1), np.frombuffer(f.as_buffer(), np.float32)

    def add(table: pa.Table) -> pa.Table:
        total = sum(_decoded(c, f).astype(np.float64) for c, f in rows_of(table))
        return pa.Table.from_batches([part(table["block"][0].as_py(), total)])

    kind = "block int, codes binary, factor binary"
    got = words.coalesce(tasks).mapInArrow(multiply, kind).groupBy("block").applyInArrow(add, kind).toArrow().sort_by("block")
    sent.destroy()
    return list(rows_of(got))


def _gram(words: DataFrame, tasks: int, place: np.ndarray, weights: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """basis' A'A basis: sums of products of the projected passages."""
    sent = words.sparkSession.sparkContext.broadcast((place, weights, codes, factor))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weights, codes, factor = sent.value
        basis = np.concatenate([np.zeros((1, codes.shape[1]), np.float32), _decoded(codes, factor * weights[1:])])
        total = np.zeros((codes.shape[1], codes.shape[1]))
        for ids, share in _passages(batches, place, weights):
            rows = _sums(basis, ids)
            total += (rows * share[:, None]).T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    got = words.coalesce(tasks).mapInArrow(multiply, "part binary").toArrow()
    sent.destroy()
    return sum(np.frombuffer(p.as_py()) for p in got["part"]).reshape(codes.shape[1], -1)


def _orthogonal(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal basis of the columns of blocks of rows, coded; columns that hardly differ from the others are dropped."""
    products = sum(r.T @ r for r in (_decoded(*b).astype(np.float64) for b in blocks))
    values, turn = np.linalg.eigh(products)
    kept = values > 1e-9 * values[-1]
    turn = (turn[:, kept] / np.sqrt(values[kept])).astype(np.float32)
    codes, factor = zip(*(_coded(_decoded(*b) @ turn) for b in blocks))
    return np.concatenate(codes), np.concatenate(factor)


@dataclass(frozen=True)
class Space:
    """Weights of all buckets and the latent vectors, weights included, of those in use; row 0 is for all others."""

    weights: np.ndarray
    place: np.ndarray
    vectors: np.ndarray

    def __reduce__(self):
        return _space, (self.weights, self.place, *_coded(self.vectors))  # 16 bits a number on the way to tasks

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.vectors[self.place[ids]]

    def weighted(self, ids: np.ndarray) -> np.ndarray:
        """The words that items have or few documents."""
        return ids[self.weights[ids] > 0]


def _space(weights: np.ndarray, place: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> Space:
    return Space(weights, place, _decoded(codes, factor))


def latent_space(words: DataFrame, weights: np.ndarray, found: np.ndarray) -> Space:
    """The space of all weighted words that are ``found`` in texts or items (how many have each), whose hashed
    rows ``words`` are. Frequent words come first, so that their rows stay in the cache."""
    used = np.flatnonzero((weights > 0) & (found > 0))
    used = used[np.argsort(-found[used], kind="stable")]
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    vectors = np.zeros((len(used) + 1, RANK), np.float32)
    if not len(used):
        return Space(weights, place, vectors)
    own = np.append(np.float32(0), weights[used])
    tasks = int(min(max(1, found.sum() // PART), words.sparkSession.sparkContext.defaultParallelism))
    draws, width = np.random.default_rng(42), min(RANK + EXTRA, len(used))
    blocks = [_coded(draws.standard_normal((min(ROWS, len(used) - b), width), np.float32)) for b in range(0, len(used), ROWS)]
    for _ in range(ROUNDS - 1):
        blocks = _multiplied(words, tasks, place, own, *_orthogonal(blocks))
    codes, factor = _orthogonal(blocks)
    del blocks
    values, turn = np.linalg.eigh(_gram(words, tasks, place, own, codes, factor))
    best = turn[:, np.argsort(-values)[:RANK]].astype(np.float32)
    for b in range(0, len(used), ROWS):
        vectors[1 + b:1 + b + ROWS, :best.shape[1]] = _decoded(codes[b:b + ROWS], factor[b:b + ROWS] * own[1 + b:1 + b + ROWS]) @ best
    return Space(weights, place, vectors)


# ---- items and matches


@dataclass(frozen=True)
class Item:
    """A benchmark text: its words and those of its answer (the last sentence), with bit masks of their places."""

    item_id: int
    size: int
    n: int
    words: dict[int, int]
    n_answer: int
    answer: dict[int, int]


def _masks(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(ids):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, with one bit per word of the item."""
    full = (1 << n) - 1
    row = full
    for m in map(masks.get, words):
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def window_size(n: int) -> int:
    """The window for an item of n words: SHORTEST times the power of sqrt(2) that is nearest in ratio."""
    return round(SHORTEST * 2 ** (max(0, round(2 * np.log2(n / SHORTEST))) / 2))


def read_items(rows: list[tuple[int, str]], space: Space) -> tuple[list[Item], np.ndarray]:
    """Items that can be searched, and their unit vectors."""
    items, vectors = [], []
    for item_id, text in rows:
        own = space.weighted(buckets_of(text or ""))
        vector = space.of(own).sum(axis=0)
        length = float(np.sqrt((vector * vector).sum()))
        if length < 1e-6:
            continue
        sentences = [space.weighted(buckets_of(s)) for s in re.split(r"[.!?]\s+", text)]
        answer = next((s for s in reversed(sentences) if len(s)), own)
        answer = answer if len(answer) >= 3 else own[-8:]
        items.append(Item(item_id, window_size(len(own)), len(own), _masks(own.tolist()), len(answer), _masks(answer.tolist())))
        vectors.append(vector / length)
    return items, np.array(vectors, np.float32).reshape(-1, RANK)


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of the ranges start .. start + count - 1, with the number of its range."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) + (start - (np.cumsum(count) - count))[which]


def _before(marks: np.ndarray, n: int) -> np.ndarray:
    """Where a mark stands, and up to n places before one."""
    at = np.flatnonzero(marks)
    edges = np.bincount(np.maximum(at - n, 0), minlength=len(marks) + 1) - np.bincount(at + 1, minlength=len(marks) + 1)
    return np.cumsum(edges)[:-1] > 0


def _settled(near: np.ndarray, some: np.ndarray, gap: int) -> bool:
    """Whether windows left out cannot matter: in each stretch of ``some`` numbers that does not begin at 0, ``gap``
    windows in a row among the first LEAD are near to no item, so none before them covers a later one."""
    stretch = np.flatnonzero(np.diff(some, prepend=-1) > 1)
    return all("0" * gap in "".join("01"[x] for x in column[a:a + LEAD].tolist()) for column in near.T for a in stretch.tolist())


class Search:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[Item], vectors: np.ndarray, space: Space):
        self.items, self.space = items, space
        sizes = sorted({i.size for i in items})
        self.by_size = [(s, [i for i in items if i.size == s], [k for k, i in enumerate(items) if i.size == s]) for s in sizes]
        self.by_size = [(s, max(i.n for i in own), own, at, np.ascontiguousarray(vectors[at].T)) for s, own, at in self.by_size]
        self.reach = max((s + 2 * longest for s, longest, _, _, _ in self.by_size), default=1)
        self.need = np.array([LOOSE * i.n for i in items])
        self.span = np.zeros(len(items), np.int64)  # words of a region that is checked for the item
        for size, longest, _, numbers, _ in self.by_size:
            self.span[numbers] = size + 2 * longest
        # words of the items, item by item and word by word: with the times the item has them
        own = [(w, k, m.bit_count()) for k, i in enumerate(items) for w, m in i.words.items()]
        own = np.array(own, np.int64).reshape(-1, 3)
        self.word, self.times = own[:, 0], own[:, 2]
        self.begin = np.searchsorted(own[:, 1], np.arange(len(items) + 1))
        own = own[np.argsort(own[:, 0], kind="stable")]
        self.holder, self.held = own[:, 1], own[:, 2]
        self.first = np.searchsorted(own[:, 0], np.arange(BUCKETS + 1))

    def leaks(self, text: str) -> list[dict]:
        return self.leaks_of_all([text])[0]

    def leaks_of_all(self, texts: list[str]) -> list[list[dict]]:
        """The leaks of each text; chunks of several texts are bounded together."""
        best: list[dict[int, dict]] = [{} for _ in texts]
        size = max(CHUNK, 4 * self.reach)
        chunks, n = [], 0
        for k, ids in enumerate(buckets_of_all(texts)):
            at = np.flatnonzero(self.space.weights[ids] > 0)
            for a in range(0, max(1, len(at) - self.reach), size - self.reach):
                part = at[a:a + size]
                chunks.append((k, ids[part], part))
                n += len(part)
                if n > WORDS or len(chunks) * len(self.items) > CELLS:
                    self._chunks(chunks, best)
                    chunks, n = [], 0
        self._chunks(chunks, best)
        return [[found[i] for i in sorted(found)] for found in best]

    def _chunks(self, chunks: list[tuple[int, np.ndarray, np.ndarray]], best: list[dict[int, dict]]) -> None:
        """Chunks are (number of the text, weighted words, their places in the text)."""
        open_items: dict[int, list[tuple[int, np.ndarray]]] = {}
        for c, item, shared in self._shared([ids for _, ids, _ in chunks]):
            open_items.setdefault(c, []).append((item, shared))
        for c, found in open_items.items():
            text, ids, at = chunks[c]
            self._chunk(ids, at, dict(found), best[text])

    def _shared(self, chunks: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(chunk, item, bounds): by first word of a region of the item's span, how many words both have at all, each as
        often as both have it. No subsequence is longer. Only chunks and items where some region reaches LOOSE."""
        lengths = np.array([len(c) for c in chunks], np.int64)
        ids = np.concatenate([np.zeros(0, np.int32), *chunks])
        some = np.flatnonzero(self.first[ids + 1] > self.first[ids])
        chunk = np.repeat(np.arange(len(chunks)), lengths)[some]
        place = some - (np.cumsum(lengths) - lengths)[chunk]
        keys = chunk * BUCKETS + ids[some]
        order = np.argsort(keys, kind="stable")
        keys, place = keys[order], place[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        known, counts = keys[starts], np.diff(starts, append=len(keys))
        # whole chunks
        in_chunk, word = np.divmod(known, BUCKETS)
        low = self.first[word]
        n, at = _ranges(low, self.first[word + 1] - low)
        shared = np.bincount(in_chunk[n] * len(self.items) + self.holder[at], np.minimum(counts[n], self.held[at]), len(chunks) * len(self.items))
        chunk, item = np.nonzero(shared.reshape(len(chunks), len(self.items)) >= self.need)
        # regions of the chunks and items left, by the first and last region that a word counts in
        ends = np.cumsum(lengths[chunk] + 1)
        a = 0
        while a < len(chunk):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")))
            some_chunk, some_item = chunk[a:b], item[a:b]
            pair, at = _ranges(self.begin[some_item], np.diff(self.begin)[some_item])
            key = some_chunk[pair] * BUCKETS + self.word[at]
            slot = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            hit = known[slot] == key
            pair, at, slot = pair[hit], at[hit], slot[hit]
            n, occurrence = _ranges(starts[slot], counts[slot])
            pair, times, before = pair[n], self.times[at[n]], starts[slot[n]]
            earlier = occurrence - times
            earlier = np.where(earlier >= before, place[np.maximum(earlier, 0)], -1)
            begin = ends[a:b] - lengths[some_chunk] - 1
            begin -= begin[0]
            from_ = begin[pair] + np.maximum(np.maximum(earlier, place[occurrence] - self.span[some_item[pair]]) + 1, 0)
            cells = int(begin[-1] + lengths[some_chunk[-1]] + 1)
            bounds = np.cumsum(np.bincount(from_, minlength=cells) - np.bincount(begin[pair] + place[occurrence] + 1, minlength=cells))
            for k in np.flatnonzero(np.maximum.reduceat(bounds, begin) >= self.need[some_item]).tolist():
                c = int(some_chunk[k])
                yield c, int(some_item[k]), bounds[begin[k]:begin[k] + lengths[c]].copy()
            a = b

    def _chunk(self, ids: np.ndarray, at: np.ndarray, bounds: dict[int, np.ndarray], best: dict[int, dict]) -> None:
        """Candidates among the weighted words ``ids`` that stand at the places ``at`` of the text, of the items with
        ``bounds``; where the bound is too small a check would find nothing."""
        words = ids.tolist()
        for size, longest, items, numbers, vectors in self.by_size:
            left = np.array([j for j, k in enumerate(numbers) if k in bounds], np.int64)
            if not len(left):
                continue
            step = max(1, size // 4)
            first = np.arange(0, max(1, len(ids) - size // 2), step)
            last = np.minimum(first + size, len(ids))
            low, high = np.maximum(0, first - longest), np.minimum(len(ids), first + size + longest)
            may = np.array([bounds[numbers[j]][low] >= self.need[numbers[j]] for j in left])
            some = np.flatnonzero(_before(may.any(axis=0), LEAD))
            cosine, near = self._near(ids, first[some], last[some], vectors[:, left])
            if not _settled(near, some, max(1, (min(size, longest) - step) // step)):
                some = np.arange(len(first))
                cosine, near = self._near(ids, first, last, vectors[:, left])
            j, w = np.nonzero(near.T)  # item by item, in the order of the text
            row = some[w]
            seen, until, around = -1, -1, {}  # regions by window, with their distinct words
            for item, row, start, possible, c in zip(left[j].tolist(), row.tolist(), first[row].tolist(), may[j, row].tolist(), cosine[w, j].tolist()):
                if item != seen or start > until:  # else an item that starts about there lies inside the last one checked
                    seen, until = item, start + min(size, longest) - size // 4
                    if not possible:
                        continue
                    a, b = int(low[row]), int(high[row])
                    if row not in around:
                        around[row] = words[a:b], set(words[a:b])
                    found = self._check(items[item], *around[row])
                    if found:
                        self._keep(items[item], found, c, int(at[a]), int(at[b - 1]) + 1, best)

    def _near(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of windows with the vectors of items, and where they reach COSINE; only words of the windows are looked up."""
        edges = np.bincount(first, minlength=len(ids) + 1) - np.bincount(last, minlength=len(ids) + 1)
        inside = np.cumsum(edges)[:-1] > 0
        place = np.append(0, np.cumsum(inside))
        sums = np.zeros((int(place[-1]) + 1, RANK), np.float32)
        np.cumsum(self.space.of(ids[inside]), axis=0, out=sums[1:])
        window = sums[place[last]] - sums[place[first]]
        length = np.sqrt(np.einsum("ij,ij->i", window, window))[:, None]
        cosine = window @ vectors
        near = cosine >= COSINE * np.maximum(length, 1e-6)
        return np.divide(cosine, length, out=np.zeros_like(cosine), where=near), near

    @staticmethod
    def _check(item: Item, words: list[int], present: set[int]) -> tuple[float, float] | None:
        """(overlap, answer) of a leak. The words shared at all, as often as both have them, bound the subsequence from above."""
        shared = item.words.keys() & present
        if len(shared) + item.n - len(item.words) < LOOSE * item.n:
            return None
        words = [w for w in words if w in shared]
        counts = Counter(words)
        if sum(min(counts[w], item.words[w].bit_count()) for w in shared) < LOOSE * item.n:
            return None
        overlap = common(item.words, item.n, words) / item.n
        if overlap < LOOSE:
            return None
        answer = common(item.answer, item.n_answer, words) / item.n_answer
        return (overlap, answer) if overlap >= NEAR or answer >= ANSWER else None

    @staticmethod
    def _keep(item: Item, found: tuple[float, float], cosine: float, first: int, last: int, best: dict[int, dict]) -> None:
        known = best.get(item.item_id)
        if known is None or found[0] > known["overlap"]:
            best[item.item_id] = {"item_id": item.item_id, "cosine": round(cosine, 6), "overlap": found[0], "answer": found[1],
                                  "first": first, "last": last}


def leak_finder(search: Search):
    """An Arrow function from texts to their leaks."""

    @F.arrow_udf(LEAKS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("overlap", pa.float64()),
                                   ("answer", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))
        for texts in batches:
            parts = (texts.slice(a, TEXTS).to_pylist() for a in range(0, len(texts), TEXTS))
            yield pa.array([found for part in parts for found in search.leaks_of_all([t or "" for t in part])], kind)

    return run.asNondeterministic()  # else a filter that Spark infers would search every text twice


def leaks_of(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_ITEMS) -> Column:
    """The benchmark items found in each text of docs."""
    words = hashed(docs)
    rows, found = counted(words)
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    asked = hashed(items)
    n_asked = counted(asked)[1]
    space = latent_space(words.unionByName(asked.withColumn("copies", F.transform("copies", lambda _: F.lit(1).cast("long")))), weigh(rows, found, n_asked > 0), found + n_asked)
    n = max(1, -(-items.count() // block))
    columns: list[Column] = []
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).orderBy("item_id", "text")
        read, vectors = read_items([(r["item_id"], r["text"]) for r in part.collect()], space)
        columns.append(leak_finder(Search(read, vectors, space))(F.col("text")))
    return F.concat(*columns) if n > 1 else columns[0]


def with_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with ``leaks`` (a column of that name is replaced)."""
    return docs.withColumn("leaks", leaks_of(docs, benchmark))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak."""
    return docs.where(F.size(leaks_of(docs, benchmark)) == 0)


def leak_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.inline("leaks"))
