"""Alignment of two tokenizers over the same text.

Tokenizer A reads a space and the text, tokenizer B adds that space itself, so the bytes of the
tokens of either join to the same string. A place where a token of A and a token of B both
end cuts the text into groups. Common ends are found by a galloping intersection: the
shorter list of ends drives; for each of its ends the other list is searched from the last
found place by doubling steps and then by halves. Ends are searched in blocks, all ends of
a block from the block's own starting place, so that NumPy takes each step for the whole
block. The ranks of common ends slice both token lists, and the differences of the ranks
say how many tokens of A and B share a group.

Per document the linked id pairs are stored with their number of links. Counting documents
per pair is one aggregation. Counts come back by broadcast for the pairs that most documents
hold, as many as the stated bound admits, and by a shuffle join for the many rare ones.

Defined results: null and empty texts, and texts that one tokenizer does not give back byte by
byte (a literal U+2581 does that), have no tokens, zero links and an empty digest; repeated
rows count as often as they stand there, each for itself; ties for the highest count are
all best; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts may be broadcast, 24 bytes each.
FREQUENT = 400_000
#: Text bytes and links worked on at once.
BATCH_BYTES, LINKS = 4 << 20, 4_000_000
BLOCK = 4096
ALIGNED = ("row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, links array<long>")
# The split of the byte-level tokenizer, and the bytes that stand for themselves in its entries.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def entry_bytes() -> dict[str, int]:
    """The byte each character of a byte-level entry stands for."""
    rest = [b for b in range(256) if b not in PLAIN]
    return {chr(b): b for b in PLAIN} | {chr(256 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("\u2581", " ").encode()


@lru_cache(maxsize=4)
def encoders(folder: str) -> tuple:
    """(encode A, encode B, bytes of the ids of A, of B, lengths of these of A, of B), loaded once per worker.

    The entries of A are its merges in order, so their ids serve as ranks; the special
    token is left out and thereby ordinary text.
    """
    import sentencepiece
    import tiktoken

    with open(f"{folder}/{A_FILE}", encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["id"] for t in spec["added_tokens"]}
    of = entry_bytes()
    ranks = {bytes(of[c] for c in entry): i for entry, i in spec["model"]["vocab"].items() if i not in special}
    a = tiktoken.Encoding("byte level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
    a_bytes = [b""] * (max(ranks.values()) + 1)
    for entry, i in ranks.items():
        a_bytes[i] = entry
    b_bytes = [b"" if b.is_control(i) else piece_bytes(b.id_to_piece(i), b.is_byte(i)) for i in range(b.get_piece_size())]
    sizes = (np.array([len(x) for x in table], np.int64) for table in (a_bytes, b_bytes))
    return a.encode_ordinary, b.encode, a_bytes, b_bytes, *sizes


def gallop(short: np.ndarray, long: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For every value of the ascending ``short`` the first rank in ``long`` whose value is not below it."""
    out, at = np.empty(len(short), np.int64), 0
    for i in range(0, len(short), block):
        x = short[i:i + block]
        low = np.full(len(x), at, np.int64)  # everything before low is smaller
        high, step, open_ = low.copy(), 1, np.arange(len(x))
        while len(open_):
            probe = np.minimum(high[open_] + step - 1, len(long))
            inside = probe < len(long)
            smaller = inside.copy()
            smaller[inside] = long[probe[inside]] < x[open_[inside]]
            high[open_] = probe
            open_ = open_[smaller]
            low[open_] = high[open_] + 1
            high[open_] = low[open_]
            step *= 2
        wide = np.flatnonzero(low < high)
        while len(wide):
            middle = (low[wide] + high[wide]) // 2
            smaller = long[middle] < x[wide]
            low[wide] = np.where(smaller, middle + 1, low[wide])
            high[wide] = np.where(smaller, high[wide], middle)
            wide = wide[low[wide] < high[wide]]
        out[i:i + block] = low
        at = int(low[-1])
    return out


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in a and in b of the values that both ascending lists hold."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    rank = gallop(short, long)
    met = rank < len(long)
    met[met] = long[rank[met]] == short[met]
    mine, other = np.flatnonzero(met), rank[met]
    return (mine, other) if len(a) <= len(b) else (other, mine)


class Aligned:
    """Tokens, groups and linked pairs of some texts, all lists laid end to end."""

    def __init__(self, texts: list[str | None], encode: tuple):
        encode_a, encode_b, a_bytes, b_bytes, size_a, size_b = encode
        a_ids, b_ids = [], []
        for text in texts:
            a = b = []
            if text:
                whole = b" " + text.encode()
                a, b = encode_a(" " + text), encode_b(text)
                if b"".join(map(a_bytes.__getitem__, a)) != whole or b"".join(map(b_bytes.__getitem__, b)) != whole:
                    a = b = []
            a_ids.append(np.array(a, np.int64))
            b_ids.append(np.array(b, np.int64))
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *ids]) for ids in (a_ids, b_ids))
        self.ends_a, self.ends_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        # Joined texts have equal lengths in A and B, so ends of different texts never meet but at a text's last token.
        self.last_a, self.last_b = common_ends(self.ends_a, self.ends_b)
        self.wide_a, self.wide_b = (np.diff(last, prepend=-1) for last in (self.last_a, self.last_b))
        self.text_of_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.text_of_group = self.text_of_a[self.last_a]
        self.n_groups = np.bincount(self.text_of_group, minlength=len(texts))

    def links(self) -> np.ndarray:
        return _per(self.text_of_group, self.wide_a * self.wide_b, len(self.n_a))

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text, empty without tokens."""
        group_a = np.repeat(np.arange(len(self.wide_a)), self.wide_a)
        group_b = np.repeat(np.arange(len(self.wide_b)), self.wide_b)
        before_b, upto_a = np.cumsum(self.wide_b) - self.wide_b, np.cumsum(self.wide_a)
        place_a, place_b = np.arange(len(self.a)) + before_b[group_a], np.arange(len(self.b)) + upto_a[group_b]
        comma, bar, semicolon = _decimals()
        parts = np.empty(len(self.a) + len(self.b), object)
        text_a, text_b = comma[self.a], comma[self.b]
        text_a[self.last_a], text_b[self.last_b] = bar[self.a[self.last_a]], semicolon[self.b[self.last_b]]
        parts[place_a], parts[place_b] = text_a, text_b
        cuts = np.r_[0, np.cumsum(self.n_a + self.n_b)].tolist()
        return [sha256("".join(parts[x:y].tolist())[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:])]

    def pairs(self, most: int = LINKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, pair, links) of runs of groups with about ``most`` links, by text and pair; a pair may come again in a later run."""
        start_a, start_b = np.cumsum(self.wide_a) - self.wide_a, np.cumsum(self.wide_b) - self.wide_b
        group_a = np.repeat(np.arange(len(self.wide_a)), self.wide_a)
        partners = self.wide_b[group_a]  # of each token of A
        upto, at = np.cumsum(partners), 0
        while at < len(self.a):
            done = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, done + most, "right")))
            left = np.repeat(np.arange(at, end), partners[at:end])
            offset = np.arange(len(left)) - np.repeat(upto[at:end] - partners[at:end] - done, partners[at:end])
            right = start_b[group_a[left]] + offset
            key = (self.text_of_a[left] << 32) | (self.a[left] << 16) | self.b[right]
            key, n = np.unique(key, return_counts=True)
            yield key >> 32, key & 0xFFFFFFFF, n
            at = end


@lru_cache(maxsize=1)
def _decimals() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.array([f"{i}{end}" for i in range(1 << 16)], object) for end in ",|;")


def _per(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of values by text, which ascends."""
    sums = np.r_[0, np.cumsum(values)]
    return sums[np.searchsorted(text, np.arange(n), "right")] - sums[np.searchsorted(text, np.arange(n), "left")]


def _merged(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(runs) == 1:
        return runs[0]
    key = np.concatenate([(t << 32) | p for t, p, _ in runs])
    key, place = np.unique(key, return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, place, np.concatenate([r[2] for r in runs]))
    return key >> 32, key & 0xFFFFFFFF, n


def _rows(folder: str, most: int):
    def batch_rows(ids: list, docs: list, texts: list[str | None], encode: tuple) -> pa.RecordBatch:
        found = Aligned(texts, encode)
        text, pair, n = _merged(list(found.pairs(most)) or [(np.zeros(0, np.int64),) * 3])
        cuts = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v, pa.int64())) for v in (pair, n)]
        columns = [pa.array(v, pa.int64()) for v in (ids, docs, found.n_a, found.n_b, found.n_groups, found.links())]
        names = [c.split()[0] for c in ALIGNED.split(", ")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(found.digests(), pa.string()), *lists], names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoders(folder)
        for batch in batches:
            ids, docs, texts = (batch[c] for c in ("row_id", "doc_id", "text"))
            sizes = np.cumsum([0, *(t.as_buffer().size if t.is_valid else 0 for t in texts)])
            at = 0
            while at < len(texts):  # texts of about BATCH_BYTES at a time
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BATCH_BYTES, "right")) - 1)
                yield batch_rows(ids[at:end].to_pylist(), docs[at:end].to_pylist(), texts[at:end].to_pylist(), encode)
                at = end

    return align


def aligned(docs: DataFrame, folder: str = TOKENIZERS, most: int = LINKS) -> DataFrame:
    """One row per row of docs: tokens, groups, links, the digest of the groups and the linked pairs with their links.
    A pair is the id of A times 2^16 plus the id of B."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_rows(folder, most), ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold a pair linked, and whether no pair of its A id is in more."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = stored(counts.withColumn("a", F.shiftright("pair", 16)), "align-counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # one row per id of A: bounded by its vocabulary
    return counts.join(F.broadcast(top), "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def frequent_from(counts: DataFrame, most: int = FREQUENT) -> int:
    """The power of two from which on at most ``most`` pairs count as frequent; 1 when all of them do."""
    levels = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 64 rows
    total, least = 0, 64
    for level, n in sorted(((r["level"], r["n"]) for r in levels), reverse=True):
        total += n
        if total > most:
            break
        least = level
    return 1 << min(least, 62) if total > most else 1


def scored(found: DataFrame, most: int = FREQUENT) -> DataFrame:
    """Per row of ``aligned`` the best links and the sum of counts over all links."""
    counts = stored(pair_counts(found), "align-best")
    least = frequent_from(counts, most)
    keys = ["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    linked = found.select("row_id", F.explode(F.arrays_zip("pairs", "links")).alias("k")).select("row_id", F.col("k.pairs").alias("pair"), F.col("k.links").alias("links"))

    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
                                          F.sum(F.col("links") * F.col("count")).alias("count_sum"))

    known = linked.join(F.broadcast(counts.where(F.col("count") >= least)), "pair", "left")
    parts = known.where("count IS NOT NULL")
    if least > 1:
        rare = known.where("count IS NULL").select("row_id", "pair", "links").join(counts.where(F.col("count") < least), "pair")
        parts = parts.select("row_id", "links", "count", "best").unionByName(rare.select("row_id", "links", "count", "best"))
    summed = sums(parts)
    zero = F.lit(0).cast("long")
    return found.select(*keys).join(summed, "row_id", "left").select(
        *keys, *[F.coalesce(c, zero).alias(c) for c in ("n_best", "count_sum")])


def align_table(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    found = stored(aligned(docs, folder), "align-rows")
    return scored(found).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
