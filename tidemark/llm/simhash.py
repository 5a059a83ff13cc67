"""SimHash near-duplicates with covering locality-sensitive hashing.

Every bit position gets one of the 2^(r+1) - 1 non-zero vectors of r + 1 bits. For
every such vector v the mask of table v has the positions whose vector has an odd
product with v. Up to r differing positions always leave a v that is orthogonal to
all of them, so two fingerprints within the radius agree under some mask: links
are found without a miss, whatever the data.

Equal fingerprints are one node. Tables are joined on masked values inside small
buckets; fingerprints that meet in a bucket above ``pair_limit`` are linked through
all values at most r/2 flips away instead (two fingerprints share such a value if
and only if they differ in at most r bits), so no bucket is ever expanded into pairs
and none is cut.

``kept_documents`` links texts by the similarity of their sets of five-word shingles, 0.8 or
more. At that similarity some 15 % of the bits differ, too many for one covering, so the
fingerprint has 1,008 bits in 28 parts with a small covering each: pairs that meet in a bucket
of any part are candidates (beyond the radius of a part they still meet by chance in one of
84 tables), the whole fingerprint rules out chance meetings, and the similarity of the sets
decides. In buckets above ``pair_limit`` (two members) members are first compared with the smallest one, and
then all pairs that are not yet in one component.

Defined results: a null or blank text has fingerprint zero, linked like any other (and the empty
set of shingles, similar to itself only); repeated ids and texts are one node; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, stored
from tidemark.llm.graph import components

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2
PAIR_LIMIT = 32
STEP = 1 << 15

#: The near-duplicate stage: words of a shingle, similarity of the sets, parts of the fingerprint.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
PARTS = 28
PART_BITS = 36
PART_RADIUS = 1
#: Members of the largest bucket whose pairs are all candidates at once; beyond, a group of near copies would give the
#: square of its size, so members meet the smallest one first and then only members of other components.
SIMILAR_PAIR_LIMIT = 2
#: Share of differing bits up to which a candidate is checked. Sets of similarity 0.8 differ in 15 %
#: (19 % for the smallest sets), with a deviation of 1.2 %.
LOOSE = 0.25


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingle hashes, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    total, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for start in range(0, n, STEP):
        part = words[start:start + STEP + shingle - 1]
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(shingle)))]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        marks = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks.view(np.int64))], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) of every row, from the whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, text_hash long, fp long")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask per non-zero vector, as signed 64-bit numbers."""
    n = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i in range(bits) if (v & (i % n + 1)).bit_count() % 2)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def _flips(most: int) -> list[int]:
    flips = [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(BITS), k)]
    return [f - (1 << BITS) if f >> (BITS - 1) else f for f in flips]


def links(nodes: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b) links that connect exactly the distinct ``fp`` within the radius (an even number).

    Beyond large buckets every linked pair is given; inside them the pairs are given through
    their smallest neighbour, which leaves the components as they are.
    """
    if radius % 2:
        raise ValueError("the radius has to be even")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))])
    keyed = nodes.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(keyed.join(shared, ["t", "key"]), "simhash-buckets")
    small = met.where(F.col("n") <= pair_limit)
    left, right = (small.select("t", "key", F.col("fp").alias(c)) for c in "ab")
    near = left.join(right, ["t", "key"]).where("a < b AND bit_count(a ^ b) <= " + str(radius)).select("a", "b")
    large = met.where(F.col("n") > pair_limit).select("fp").distinct()
    around = large.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in _flips(radius // 2)])).alias("v"))
    low = around.groupBy("v").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = around.join(low, "v").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(star)


def groups(marked: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(fp, chosen, component_id): of all rows a fingerprint is linked with, the one with the smallest id
    (doc_id and text_hash; rows without an id come last) and its id."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = stored(marked.groupBy("fp").agg(F.min(place).alias("own")), "simhash-nodes")
    tied = components(links(nodes, radius, pair_limit), "a", "b")
    rooted = nodes.join(tied, nodes["fp"] == tied["node"], "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("own").alias("chosen"))
    return rooted.join(least, "root").select("fp", "chosen", F.col("chosen.doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    marked = stored(fingerprints(docs, shingle), "simhash-marks")
    return marked.join(groups(marked, radius).select("fp", "component_id"), "fp").drop("text_hash")


def shingle_set(text: bytes, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of a text (fewer words: of the whole sequence; none: empty)."""
    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    found = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))]
    return np.unique(np.array(found, np.uint64))


def wide_parts(hashes: np.ndarray) -> np.ndarray:
    """Majority bits of a set of hashes over all parts, one number a part."""
    lanes = -(-PARTS * PART_BITS // BITS)
    counts = np.zeros(lanes * BITS, np.int64)
    for start in range(0, len(hashes), 255):
        # 255 rows at most, so that the sums fit one byte; every lane is a splitmix64 of the hash.
        z = hashes[start:start + 255, None] + np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    bits = (2 * counts > len(hashes))[:PARTS * PART_BITS].reshape(PARTS, PART_BITS)
    return bits @ (np.int64(1) << np.arange(PART_BITS, dtype=np.int64))


def _wide_marks(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py() or b"", shingle) for t in batch.column(2).cast(pa.binary())]
        node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
        parts = pa.array([wide_parts(h) for h in sets], pa.list_(pa.int64()))
        columns = [batch.column(0), batch.column(1), pa.array(node), pa.array([len(h) for h in sets], pa.int32()), parts]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "size", "parts"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py() or b"", shingle).view(np.int64) for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def _same_row(side: DataFrame) -> Column:
    return F.col("doc_id").cast("long").eqNullSafe(side["near_id"]) & (F.xxhash64("text") == side["near_hash"])


def _row_keys(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("doc_id").alias("near_id"), F.col("text_hash").alias("near_hash"), *more)


def similar_pairs(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The candidate pairs (a, b) whose sets of shingles are similar, stored.

    Only nodes of pairs that pass the whole fingerprint have their texts read again.
    """
    left, right = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("parts").alias(f"parts_{c}")) for c in "ab")
    differ = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = F.least("size_a", "size_b") >= F.floor(similarity * F.greatest("size_a", "size_b"))
    near = pairs.join(left, "a").join(right, "b").where(sizes & (differ <= int(LOOSE * PARTS * PART_BITS)))
    near = stored(near.select("a", "b"), "simhash-near")
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(_row_keys(nodes.join(ends, "node").select("node", "own.doc_id", "own.text_hash"), "node"), "simhash-wanted")
    texts = attach(docs.select("doc_id", "text"), wanted, _same_row(wanted)).select("node", "text")
    sets = stored(texts.mapInArrow(lambda it: _sets(it, shingle), "node long, shingles array<long>").dropDuplicates(["node"]), "simhash-sets")
    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    common = F.size(F.array_intersect("set_a", "set_b"))
    share = common / (F.size("set_a") + F.size("set_b") - common)
    return stored(near.join(x, "a").join(y, "b").where(share >= similarity).select("a", "b"), "simhash-links")


def similar_groups(docs: DataFrame, marked: DataFrame, shingle: int, similarity: float, pair_limit: int = SIMILAR_PAIR_LIMIT) -> DataFrame:
    """(doc_id, text_hash) of one row of each group: that with the smallest id (rows without an id come last)."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "size", "parts")
    nodes = marked.groupBy("node").agg(F.min(place).alias("own")).select("node", "own", "own.size", "own.parts")
    nodes = stored(nodes, "simhash-nodes")
    covers = masks(PART_RADIUS, PART_BITS)
    keys = [F.xxhash64(F.lit(p * len(covers) + t), F.col("parts")[p].bitwiseAND(F.lit(m))) for p in range(PARTS) for t, m in enumerate(covers)]
    keyed = nodes.where("size > 0").select("node", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1")
    met = stored(keyed.join(shared, "key"), "simhash-buckets")
    small, large = met.where(F.col("n") <= pair_limit), met.where(F.col("n") > pair_limit)
    left, right = (small.select("key", F.col("node").alias(c)) for c in "ab")
    star = large.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = left.join(right, "key").where("a < b").select("a", "b").unionByName(star).distinct()
    tied = components(similar_pairs(docs, nodes, pairs, shingle, similarity), "a", "b")
    rooted = nodes.join(tied, "node", "left").select("node", "own", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "simhash-roots")
    roots = rooted.select("node", "root")
    if not large.isEmpty():
        inside = large.select("key", "node").join(roots, "node")
        mixed = inside.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        inside = stored(inside.join(mixed, "key"), "simhash-mixed")
        left, right = (inside.select("key", F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        apart = left.join(right, "key").where("root_a < root_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = similar_pairs(docs, nodes, apart, shingle, similarity)
        ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
        tops = components(more.join(ends[0], "a").join(ends[1], "b"), "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("top"))
        rooted = rooted.join(tops, "root", "left").select("node", "own", F.coalesce("top", "root").alias("root"))
    return rooted.groupBy("root").agg(F.min("own").alias("own")).select("own.doc_id", "own.text_hash")


def kept_documents(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, pair_limit: int = SIMILAR_PAIR_LIMIT) -> DataFrame:
    """One row of docs per group of similar texts: that with the smallest id.

    Documents are read in place: what is joined to them are the keys of rows to leave out, by broadcast
    where their counted size allows it. Rows with equal id and text are told apart by nothing, so one of them stays.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, node long, size int, parts array<long>"
    marked = stored(rows.mapInArrow(lambda it: _wide_marks(it, shingle), schema), "simhash-marks")
    chosen = _row_keys(similar_groups(docs, marked, shingle, similarity, pair_limit)).withColumn("stays", F.lit(True))
    counted = marked.groupBy("doc_id", "text_hash").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    same = F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("text_hash") == F.col("near_hash"))
    judged = counted.join(chosen, same, "left").select("doc_id", "text_hash", "repeated", F.coalesce("stays", F.lit(False)).alias("stays"))
    special = stored(_row_keys(judged.where("repeated OR NOT stays"), "stays"), "simhash-special")
    repeated = special.where("stays")
    out = attach(docs, special, _same_row(special), "left_anti")
    if not repeated.isEmpty():
        out = out.unionByName(attach(docs, repeated, _same_row(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
    return out


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
