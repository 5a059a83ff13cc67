"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on two questions, "is this junk" and "is this
toxic"; people's labels are one more labeller that is silent on most documents. For
each question expectation-maximisation estimates from the counts of vote patterns how
often every labeller accuses documents of either kind, and so the chance that
a document is bad. These chances are the labels of a sparse logistic scorer over
hashed features (words, word beginnings, shares of odd tokens), which decides alone.

Votes are counted over all documents and every whole text is scored. Two bounded
samples, chosen by hash, reach the driver: at most LABELLED labelled documents (words
that only toxic ones have become two labellers) and TRAINED more for the scorer; the
patterns are at most 3^labellers. Both bounds are parameters.

Defined results: a null or empty text has no words, no votes against it and the score
of the intercept; labels of unknown documents are ignored, repeated labels count once with
the worst values, without labels the built-in labellers decide; repeated rows are scored
alike and count one by one in the patterns, but an id enters a sample once, with the text
of the smallest hash; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import fsum
from operator import and_, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import attach, stored, unit

BUCKETS = 1 << 18
LABELLED = 4000
TRAINED = 4000
BEGINNINGS = (4, 5, 6)
CACHE = 200_000
LIMIT = 0.5
PENALTY = 2e-4
# Common insults of English, in two overlapping lists.
INSULTS = (
    frozenset(b"idiot moron stupid clown loser pathetic trash".split()),
    frozenset(b"trash scum worthless disgusting pathetic loser idiot".split()),
)
JUNK = ("shouts", "exclaims", "symbols", "tails", "pipes", "loose", "stutters", "runs")
TOXIC = ("insults", "insults too", "learned", "learned too")
#: An innocent document is accused by a labeller at most so often.
SLANDER = 0.004
#: Buckets count that are so many standard deviations off.
FAR = 4.0


def tokens(text: str) -> tuple[list[str], set[bytes]]:
    """All words, and the distinct lower-case runs of letters and digits."""
    return text.split(), set(text.lower().encode("utf-8", "replace").translate(_SPLIT).split())


def shares(text: str, words: list[str]) -> tuple[float, ...]:
    """Shares that speak for junk, one per labeller of JUNK; two look at each kind of it."""
    n, size = max(len(words), 1), max(len(text), 1)
    again = list(map(eq, words, words[1:]))
    return (
        sum(map(str.isupper, words)) / n,
        text.count("!!") / n,
        sum(map(text.count, SYMBOLS)) / size,
        sum(map(text.count, TAILS)) / n,
        text.count("|") / n,
        list(map(len, words)).count(1) / n,
        sum(again) / n,
        sum(map(and_, again, again[1:])) / n,
    )


#: ASCII other than letters and digits separates tokens.
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SYMBOLS = "*$%&#"
TAILS = [s + space for s in SYMBOLS for space in " \n"]
FIRES = (0.15, 0.08, 0.01, 0.1, 0.08, 0.25, 0.08, 0.05)


def marks(share: tuple[float, ...]) -> list[bytes]:
    """Pseudo-words for the shares, in steps that grow from 1/64 on."""
    return [b"\0%b%d" % (name.encode(), int(64 * s).bit_length()) for name, s in zip(JUNK, share)]


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def word_buckets(word: bytes) -> list[int]:
    """The word and its beginnings (of whole characters)."""
    starts = [word]
    if len(word) > BEGINNINGS[0]:
        if word.isascii():
            starts += [b"\1" + word[:k] for k in BEGINNINGS if len(word) > k]
        else:
            text = word.decode("utf-8", "replace")
            starts += [b"\1" + text[:k].encode() for k in BEGINNINGS if len(text) > k]
    return [crc % BUCKETS for crc in map(zlib.crc32, starts)]


def hashed(text: str) -> list[int]:
    """Buckets of a text: each distinct word with its beginnings, and the marks."""
    words, distinct = tokens(text)
    out = [b for w in distinct for b in word_buckets(w)]
    return out + [bucket(m) for m in marks(shares(text, words))]


class Remembered(dict):
    """A value per word, worked out when the word is met first; forgotten when there are too many."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, word: bytes):
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = self.value(word)
        return found


class Score:
    """Sums of the weights of texts; exact sums, so that the order of words changes nothing."""

    def __init__(self, weights: np.ndarray):
        self.weights = {int(b): float(weights[b]) for b in np.flatnonzero(weights)}  # few are not zero
        self.known = Remembered(lambda w: self.total(word_buckets(w)))

    def total(self, buckets: list[int]) -> float:
        return fsum(self.weights[b] for b in buckets if b in self.weights)

    def of(self, text: str) -> float:
        words, distinct = tokens(text)
        return fsum(map(self.known.__getitem__, distinct)) + self.total([bucket(m) for m in marks(shares(text, words))])


class Votes:
    """The labellers; two know the buckets learned from labelled documents."""

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.one, self.two = (frozenset(np.flatnonzero(x).tolist()) for x in (one, two))
        self.known = Remembered(self.flags)

    def flags(self, word: bytes) -> int:
        own = word_buckets(word)
        return (not self.one.isdisjoint(own)) + 2 * (not self.two.isdisjoint(own))

    def of(self, text: str) -> str:
        """One letter per labeller: x accuses, o does not."""
        words, distinct = tokens(text)
        fired = [s > f for s, f in zip(shares(text, words), FIRES)]
        fired += [not distinct.isdisjoint(lexicon) for lexicon in INSULTS]
        learned = set(map(self.known.__getitem__, distinct))
        fired += [bool(learned & {1, 3}), bool(learned & {2, 3})]
        return "".join("x" if f else "o" for f in fired)


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    return (t.as_py() or "" for t in batch.column(1))


def sample_features(docs: DataFrame) -> DataFrame:
    """(doc_id, buckets) of documents of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array([hashed(t) for t in _texts(batch)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "buckets"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, buckets array<int>")


def bounded(df: DataFrame, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows at most, by a hash of their id."""
    n = df.count()
    return df if n <= rows else df.where(unit(F.lit(salt), "doc_id") < rows / n)


class Sparse:
    """Rows of bucket lists with sums over them."""

    def __init__(self, lists: list[np.ndarray]):
        self.index = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        self.rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.n = len(lists)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.index], self.n)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, values[self.rows], BUCKETS)


def telling(rows: Sparse, toxic: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Marks the buckets in use that several toxic rows and next to no clean row have."""
    bad, good = rows.back(toxic.astype(float)), rows.back(1.0 - toxic)
    return (bad >= 3) & (good <= 0.02 * bad) & buckets


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(chance of bad per pattern, accuracies [labeller, bad or not, vote]).

    Votes are 0 (no), 1 (accuses) and 2 (silent); labellers are independent given the truth.
    """
    one = np.stack([patterns == v for v in range(3)], axis=2).astype(float)
    chance = np.clip((patterns == 1).any(axis=1).astype(float), 0.02, 0.9)
    for _ in range(rounds):
        table, share = [], []
        for z in (1 - chance, chance):
            w = z * counts
            share.append(w.sum() + 1)
            cell = np.einsum("p,plv->lv", w, one) + np.array([1.0, 0.1, 0.1])
            table.append(cell / cell.sum(axis=1, keepdims=True))
        over = np.maximum(table[0][:, 1] - SLANDER, 0)
        table[0][:, 1] -= over
        table[0][:, 0] += over
        logs = [np.log(s) + np.einsum("plv,lv->p", one, np.log(t)) for s, t in zip(share, table)]
        after = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        done = np.abs(after - chance).max() < 1e-9
        chance = after
        if done:
            break
    return chance, np.stack(table, axis=1)


def screened(rows: Sparse, chance: np.ndarray) -> np.ndarray:
    """Buckets whose share of bad rows is far from the share of all rows."""
    n, bad, p = rows.back(np.ones(rows.n)), rows.back(chance), float(np.clip(chance.mean(), 1e-3, 1 - 1e-3))
    return np.abs(bad - p * n) > FAR * np.sqrt(p * (1 - p) * np.maximum(n, 1))


def fit_logistic(rows: Sparse, chance: np.ndarray, penalty: float = PENALTY, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Sparse weights and intercept of a logistic scorer for soft labels (accelerated soft thresholding
    on the screened buckets)."""
    if not rows.n:
        return np.zeros(BUCKETS, np.float32), -1.0
    use = screened(rows, chance)
    kept = use[rows.index]
    thin = Sparse([])
    thin.index, thin.rows, thin.n = rows.index[kept], rows.rows[kept], rows.n
    # each weight moves by the number of rows it is in; then the curvature is at most the longest row over 4
    own = np.maximum(thin.back(np.ones(thin.n)), 1.0)
    step = 4.0 / (thin.times(np.ones(BUCKETS)).max() + 1)
    w, b, held, held_b, t = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0, 1.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-np.clip(thin.times(held) + held_b, -30, 30))) - chance
        trial = held - step * thin.back(miss) / own
        after = np.sign(trial) * np.maximum(np.abs(trial) - step * penalty * thin.n / own, 0)
        after_b = held_b - step * miss.mean()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        held, held_b = after + (before - 1) / t * (after - w), after_b + (before - 1) / t * (after_b - b)
        w, b = after, after_b
    return w.astype(np.float32), float(b)


# ---- on tables


def _collected(df: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and bucket lists of a bounded sample, in the order of the ids."""
    got = df.toArrow()
    ids = got["doc_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    lists = got["buckets"].combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return ids[order], [values[ends[i]:ends[i + 1]] for i in order]


def one_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) with one row per id of a bounded list, however many rows an id has."""
    return docs.join(F.broadcast(ids.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def vote_table(docs: DataFrame, one: np.ndarray, two: np.ndarray) -> DataFrame:
    """(doc_id, votes) of every row: a letter per labeller of JUNK and TOXIC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(one, two)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(votes.of, _texts(batch)), pa.string())], ["doc_id", "votes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, votes string")


def _chances(patterns: list[tuple[str, int]], part: slice, person: int) -> tuple[dict[str, float], np.ndarray]:
    """Chance of bad per vote pattern of one question; ``person`` is the place of people's vote."""
    merged: dict[str, int] = {}
    for votes_, n in patterns:
        key = votes_[part] + votes_[person]
        merged[key] = merged.get(key, 0) + n
    names = sorted(merged)
    if not names:
        return {}, np.zeros((0, 2, 3))
    codes = np.array([["ox-".index(c) for c in k] for k in names])
    chance, accuracy = em(codes, np.array([merged[k] for k in names], float))
    return dict(zip(names, chance)), accuracy


class Model:
    """Weights and intercept of the scorer, with the estimated accuracies of the labellers."""

    def __init__(self, weights: np.ndarray, intercept: float, accuracy: dict[str, np.ndarray]):
        self.weights, self.intercept, self.accuracy = weights, intercept, accuracy


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, trained: int = TRAINED) -> Model:
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    said = stored(labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")), "quality-labels")
    known = stored(bounded(said.where("toxic IS NOT NULL AND doc_id IS NOT NULL"), labelled, "labelled"), "quality-sample")
    ids, lists = _collected(sample_features(one_each(narrow, known)))
    toxic_of = {r["doc_id"]: float(r["toxic"]) for r in known.collect()}
    rows, toxic = Sparse(lists), np.array([toxic_of[i] for i in ids])
    first = np.zeros(BUCKETS, bool)
    if len(lists):
        first[rows.index] = True
    learned = telling(rows, toxic, first)
    halves = [learned & (np.arange(BUCKETS) % 3 != k) for k in (0, 1)]  # overlapping
    person = F.concat(*[F.coalesce(F.when(F.col(c) == bad, "x").when(F.col(c).isNotNull(), "o"), F.lit("-")) for c, bad in (("quality", 0), ("toxic", 1))])

    def voted(rows: DataFrame) -> DataFrame:
        return attach(vote_table(rows, *halves), said, "doc_id", "left").select("doc_id", F.concat("votes", person).alias("votes"))

    full = stored(voted(narrow), "quality-patterns")
    patterns = [(r["votes"], r["count"]) for r in full.groupBy("votes").count().collect()]
    n = len(JUNK)
    junk, junk_accuracy = _chances(patterns, slice(0, n), n + len(TOXIC))
    vile, vile_accuracy = _chances(patterns, slice(n, n + len(TOXIC)), n + len(TOXIC) + 1)

    def bad(v: str) -> float:
        return 1 - (1 - junk[v[:n] + v[-2]]) * (1 - vile[v[n:-2] + v[-1]])

    picked = bounded(full.where("doc_id IS NOT NULL").select("doc_id").distinct(), trained, "trained").unionByName(known.select("doc_id")).distinct()
    picked = stored(one_each(narrow, stored(picked, "quality-picked")), "quality-texts")
    ids, lists = _collected(sample_features(picked))
    seen = {r["doc_id"]: bad(r["votes"]) for r in voted(picked).collect()}
    weights, intercept = fit_logistic(Sparse(lists), np.array([seen[i] for i in ids]))
    return Model(weights, intercept, {"junk": junk_accuracy, "toxic": vile_accuracy})


def scorer(model: Model):
    """An Arrow function from texts to the chance that they are bad."""
    weights, intercept = model.weights, model.intercept

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = Score(weights)
        for texts in batches:
            scores = np.array([intercept + score.of(t.as_py() or "") for t in texts])
            yield pa.array(np.round(1 / (1 + np.exp(-np.clip(scores, -50, 50))), 9))

    return run


def with_scores(docs: DataFrame, model: Model, text: str | Column = "text") -> DataFrame:
    """docs with ``bad_chance`` (a column of that name is replaced)."""
    return docs.withColumn("bad_chance", scorer(model)(text))


def kept_documents(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The rows of docs that the scorer does not reject."""
    return docs.where(scorer(train(docs, labels))(F.col("text")) < limit)


def quality_table(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """One row per document with its chance to be bad and the verdict."""
    narrow = docs.select("doc_id", "text")
    out = with_scores(narrow, train(narrow, labels))
    return out.select("doc_id", "bad_chance", (F.col("bad_chance") < limit).alias("keep"))
