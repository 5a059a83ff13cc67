"""Near-duplicates, lines, secrets, media, quality and decontamination against plain loops."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, flac, graph, line_dedup, quality, secret_scan, simhash
from tidemark.llm.automaton import compile_patterns


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- SimHash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aBÉé \t\n\x0b\x1f ", max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover_every_pair(radius):
    rng, tables = random.Random(radius), [m % (1 << 64) for m in simhash.masks(radius)]
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & flip == 0 for m in tables)


def roots_of(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


@pytest.mark.parametrize("pair_limit", [1, 3, 32])
def test_groups_equal_a_search_of_all_pairs(spark, pair_limit):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(30)}
    for v in list(values)[:12]:
        for _ in range(8):  # chains and clusters
            v ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    marked = spark.createDataFrame([(i, i * 7, v) for i, v in enumerate(signed)], "doc_id long, text_hash long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.groups(marked, pair_limit=pair_limit).collect()}
    root = roots_of(sorted(values), 2)
    least = {}
    for i, v in enumerate(sorted(values)):
        least.setdefault(root[v], i)
    assert got == {s: least[root[v]] for s, v in zip(signed, sorted(values))}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (101, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_duplicates_of_messy_and_empty_tables(messy, nothing):
    rows = simhash.near_duplicate_table(messy).collect()
    assert len(rows) == messy.count()
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows if r["doc_id"]}
    assert by[1] == by[2] == by[3] == ("0" * 16, 1) and by[6][1] == by[7][1] == by[8][1] == 6
    kept = simhash.kept_documents(messy)
    assert kept.columns == messy.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 5, 6, 9]
    assert simhash.near_duplicate_table(nothing).count() == 0 and simhash.kept_documents(nothing).count() == 0


def plain_shingles(text, size=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1))))


def similar_roots(texts):
    """{id: smallest id reachable} over all pairs of sets that are equal or 0.8 similar."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sets:
            if j < i:
                a, b = sets[i], sets[j]
                if a == b or len(a & b) >= 0.8 * len(a | b):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i: find(i) for i in sets}


def changed(rng, words, share):
    out = [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]
    return out if rng.random() < 0.5 else out + [f"end{rng.randrange(10**6)}"]


def near_copies(seed):
    """Texts of 6 to 700 words, chains and families of copies with a few changed words, looser copies, and strangers."""
    rng, texts = random.Random(seed), {}
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 120, 700]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            texts[len(texts)] = " ".join(base)
            base = changed(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.1]))
    source = [f"f{rng.randrange(3000)}" for _ in range(200)]
    for _ in range(80):
        texts[len(texts)] = " ".join(changed(rng, source, 0.012))
    ids = rng.sample(range(10**6), len(texts))
    return dict(zip(ids, texts.values()))


@pytest.mark.parametrize("pair_limit", [2, 32])
def test_similar_texts_equal_a_search_of_all_pairs(spark, pair_limit):
    texts = near_copies(5)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in simhash.kept_documents(docs, pair_limit=pair_limit).collect()}
    root = similar_roots(texts)
    gone = {i for i in texts if root[i] != i}
    assert len(gone) > 100 and not (set(texts) - kept) - gone  # only copies go
    assert len(kept - set(root.values())) <= 0.02 * len(gone)  # and hardly any stays


def test_repeated_rows_stay_once_beside_large_groups(spark):
    docs = spark.createDataFrame([(3, "a b c d e f")] * 500 + [(i, f"x{i} y z") for i in range(10, 40)] + [(1, None)] * 40 + [(None, " ")] * 9, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.kept_documents(docs).collect())
    assert kept == [1, 3, *range(10, 40)]


# ---- lines


def plain_cut(docs):
    seen, cover = {}, {}
    for i, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        full = [(p, x.strip(" ")) for p, x in enumerate(text.split("\n")) if x.strip(" ")]
        for j in range(len(full) - 2):
            key = tuple(x for _, x in full[j:j + 3])
            if key in seen:
                cover.setdefault(i, set()).update(range(full[j][0], full[j + 2][0] + 1))
            seen.setdefault(key, i)
    return {i: t and "\n".join(x for p, x in enumerate(t.split("\n")) if p not in cover.get(i, ())) for i, t in docs}


def test_lines_equal_a_loop(spark):
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c ", "", " d", "e"]) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(99, None)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["text"] for r in out} == plain_cut(docs)


def test_lines_of_messy_and_empty_tables(messy, nothing):
    out = line_dedup.dedup_lines(messy)
    assert sorted(out.columns) == sorted(messy.columns) and out.count() == messy.count()
    rows = {r["doc_id"]: r for r in out.collect() if r["doc_id"]}
    assert rows[6]["text"].count("\n") == 2 and rows[7]["text"] == rows[8]["text"] == "" and rows[5]["text"].startswith("word other")
    assert len(rows[5]["text"]) < 200 and line_dedup.line_table(nothing).count() == 0


# ---- secrets

PLAIN = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
LEAST = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
PIECES = ["password", "token", "SECRET", "api_key", "=", ":", " ", '"', "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12", "é", "==", "\n",
          ".", "deadbeef", "token: token: abcdefgh", "f" * 24, "ghp_" + "a1" * 18]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_secrets_equal_patterns(text):
    want = sorted((m.start(), k, m.end()) for k, name in enumerate(PLAIN) for m in PLAIN[name].finditer(text) if LEAST[name](m))
    assert [s for s in secret_scan.find(text.encode()) if s[1] < 3] == want


def test_automaton_is_minimal_and_exact():
    auto = compile_patterns(["(a|b)*abb"], anywhere=False)
    assert len(auto) == 5  # four states and the one without a way on
    for text in ("abb", "aabb", "ababb", "ab", "", "abbc"):
        s = auto.start
        for b in text.encode():
            s = auto.step[s + b]
        assert (s >= auto.first) == bool(re.fullmatch("(a|b)*abb", text))


def test_secrets_of_messy_and_empty_tables(messy, nothing):
    rows = {r["doc_id"]: r for r in secret_scan.secret_table(messy).collect()}
    assert rows[9]["n_assign"] == 1 and rows[9]["spans"] == "assign:6:24" and rows[2]["spans"] == ""
    assert rows[9]["base_sha256"] == hashlib.sha256(b"assign:6:24").hexdigest()
    hidden = secret_scan.with_secrets(messy).where("doc_id = 9").select(secret_scan.redacted(F.col("text"), F.col("secrets"))).first()[0]
    assert hidden == "é ü ñ [assign] <x>" and secret_scan.secret_table(nothing).count() == 0


# ---- media


@settings(max_examples=25, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.lists(st.sampled_from([b"\x80" * 600, b"\xff\x00" * 300, b"the cat. " * 70, b"\x00" * 10]), max_size=5).map(b"".join)))
def test_media_round_trip(text):
    data = flac.payload_of(text)
    (pcm, blocks), = flac.decode(flac.encode([data]))
    assert pcm == data and len(data) % 576 == 0 and len(blocks) == len(data) // 576


def test_media_is_seekable_and_damage_is_found():
    data = flac.payload_of(bytes(random.Random(1).choices(b"etaoin shrdlu", k=5000)))
    media, = flac.encode([data])
    (_, blocks), = flac.decode([media])
    bits, _, _, _, _ = flac.read_meta(media)
    for sample, n, at, size in blocks:
        frame = np.frombuffer(media[at:at + size] + b"\0" * 16, np.uint8)
        _, samples, head = flac._read_header(media, int(at))
        x, _ = flac._decode_frames(frame, np.array([head]), samples, bits)
        assert (x[0] + 128).astype(np.uint8).tobytes() == data[sample:sample + n]
    for at in range(60, len(media), 97):
        broken = bytearray(media)
        broken[at] ^= 16
        try:
            assert flac.decode([bytes(broken)])[0][0] == data  # a seek point may be wrong: the frames are read in turn
        except flac.DamagedMedia:
            continue
        assert at < 42 + 4 + 18 * len(blocks)


def test_media_of_messy_and_empty_tables(messy, nothing):
    texts = {(r["doc_id"], r["text"]) for r in messy.collect()}
    rows = {r["doc_id"]: r for r in flac.media_table(messy).collect()}
    for i, t in texts:
        if i:
            want = flac.payload_of((t or "").encode())
            assert (rows[i]["payload_sha256"], rows[i]["payload_bytes"], rows[i]["n_bytes"]) == (hashlib.sha256(want).hexdigest(), len(want), len((t or "").encode()))
            assert rows[i]["tail_crc32"] == zlib.crc32(want[-32:])
    blocks = flac.pcm_blocks(flac.with_media(messy.where("doc_id = 6"))).orderBy("block").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks).startswith(b"one two three\n") and blocks[0]["sample_offset"] == 0
    assert flac.media_table(nothing).count() == 0


# ---- quality


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    hit, slip = (0.8, 0.6, 0.7, 0.5), (0.003, 0.002, 0.001, 0.003)
    cast = np.stack([rng.random(20_000) < np.where(truth, h, s) for h, s in zip(hit, slip)], axis=1).astype(int)
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    chance, table_ = quality.em(patterns, counts)
    assert np.allclose(table_[:, 1, 1], hit, atol=0.03) and abs((chance * counts).sum() / 20_000 - 0.3) < 0.03


def test_classifier_agrees_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    seen = labels.where("doc_id % 4 <> 1")
    model = quality.train(docs, seen)
    held = quality.with_scores(docs.join(labels.where("doc_id % 4 = 1"), "doc_id"), model).collect()
    good = [r["bad_chance"] < 0.5 for r in held if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["bad_chance"] >= 0.5 for r in held if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.85


def test_an_id_of_a_third_of_all_rows_enters_the_samples_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    hot = labels.where("quality = 1 AND toxic = 0").agg(F.min("doc_id")).first()[0]
    many = docs.unionByName(spark.range(500).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("other text "), F.col("id")).alias("text")))
    many = many.unionByName(docs.where(F.col("doc_id") == hot).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("i"))
    ids = labels.select("doc_id").distinct().limit(40).unionByName(spark.createDataFrame([(hot,)], labels.select("doc_id").schema)).distinct()
    got = quality.one_each(many, ids).collect()
    assert len(got) == len({r["doc_id"] for r in got}) and hot in {r["doc_id"] for r in got}
    rows = quality.quality_table(many, labels).collect()
    assert len(rows) == many.count() and sum(r["keep"] for r in rows if r["doc_id"] == hot) >= 400


def test_quality_of_messy_and_empty_tables(spark, messy, nothing):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (9, None, 1), (None, 1, 1), (777, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_table(messy, labels).count() == messy.count()
    kept = quality.kept_documents(messy, labels.limit(0))
    assert kept.columns == messy.columns and kept.where("bad_chance = 'x'").count() == kept.count()
    assert quality.quality_table(nothing, labels).count() == 0


# ---- decontamination


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=12), st.lists(st.integers(0, 5), max_size=12))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert decontaminate.common(decontaminate._masks(a), len(a), b) == best[-1][-1]


def test_planted_passages_are_found(spark, sf):
    rng = random.Random(8)
    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    vocabulary = [w for _, t in docs for w in t.split()]
    planted = []
    for k in range(30):
        item, text = rng.choice(items)
        words = text.split()
        if k % 2:  # a paraphrase: one word in eight replaced or left out
            words = [w for w in (rng.choice(vocabulary) if rng.random() < 0.08 else w for w in words) if rng.random() > 0.05]
        around = rng.choices(vocabulary, k=rng.choice([0, 40, 700]))
        at = rng.randint(0, len(around))
        docs.append((10_000 + k, " ".join(around[:at] + words + around[at:])))
        planted.append((10_000 + k, item))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leak_table(df, table(spark, sf, "benchmark")).collect()}
    assert set(planted) <= found
    # every other leak holds eight words of its item in a row
    texts, of = dict(docs), dict(items)
    plain = lambda t: re.findall(r"\w+", t.lower())
    for d, i in found - set(planted):
        own = " ".join(plain(texts[d]))
        words = plain(of[i])
        assert any(" ".join(words[j:j + 8]) in own for j in range(max(1, len(words) - 7)))


def test_items_in_a_third_of_the_rows_are_found(spark, sf):
    rng = random.Random(9)
    texts = [r["text"] or "" for r in table(spark, sf, "documents").select("text").collect()][:90]
    items = [(1, " ".join(f"exam{k}" for k in range(30))), (2, "what is the river that runs by the old town on the hill? It is the winding river of stones.")]
    vocabulary = [w for t in texts for w in t.split()]
    for copies in (False, True):
        docs, planted = list(enumerate(texts)), set()
        for item, text in items:
            around = rng.choices(vocabulary, k=200)
            for k in range(45):
                around = around if copies else rng.choices(vocabulary, k=rng.choice([20, 200]))
                docs.append((1000 * item + k, " ".join(around[:10] + [text] + around[10:])))
                planted.add((1000 * item + k, item))
        asked = spark.createDataFrame(items, "item_id long, text string")
        found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leak_table(spark.createDataFrame(docs, "doc_id long, text string"), asked).collect()}
        assert found == planted


def test_long_items_and_lengths_between_windows_are_found(spark, sf):
    rng = random.Random(10)
    texts = [r["text"] or "" for r in table(spark, sf, "documents").select("text").collect()][:60]
    vocabulary = [w for t in texts for w in t.split()]
    lengths = [9, 12, 14, 23, 27, 38, 46, 54, 76, 107, 150, 1000, 4000]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate(lengths)]
    docs, planted = list(enumerate(texts)), set()
    for item, text in items:
        for k, n in enumerate((0, 60, 6000)):
            around = rng.choices(vocabulary, k=n)
            at = rng.randint(0, n)
            docs.append((1000 + 10 * item + k, " ".join(around[:at] + [text] + around[at:])))
            planted.add((1000 + 10 * item + k, item))
    found = decontaminate.leak_table(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r["doc_id"], r["item_id"]): r["overlap"] for r in found.collect()}
    assert planted <= set(rows) and all(rows[p] == 1 for p in planted)


def test_windows_have_about_the_length_of_their_item():
    for n in range(8, 5000):
        assert abs(np.log2(decontaminate.window_size(n) / n)) < 0.32


def test_an_item_in_two_of_few_rows_is_found(spark):
    item = "name the metal that floats on water"
    docs = spark.createDataFrame([(1, item), (2, f"exam. {item} please"), (3, "other text that has nothing of it")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, item)], "item_id long, text string")
    for df in (docs, docs.where("doc_id < 3"), docs.where("doc_id < 2")):
        assert {r["doc_id"] for r in decontaminate.leak_table(df, asked).collect()} == {r["doc_id"] for r in df.where("doc_id < 3").collect()}


def test_frequencies_count_distinct_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["copied words"] * 7 + ["other words", None, None])], "doc_id long, text string").repartition(3)
    rows, found = decontaminate.frequencies(docs)
    assert rows == 3 and [int(found[b]) for b in decontaminate.buckets_of("copied words other")] == [1, 2, 1]


def test_leaks_of_messy_and_empty_tables(spark, messy, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "password hunter22 x"), (3, "..."), (None, "one two")], "item_id long, text string")
    assert decontaminate.clean_documents(messy, items).columns == messy.columns
    assert decontaminate.leak_table(nothing, items).count() == 0
    assert decontaminate.leak_table(messy, items.limit(0)).count() == 0


def latent_search(items):
    """A search over a space of random vectors."""
    vectors = np.random.default_rng(1).standard_normal((decontaminate.BUCKETS + 1, decontaminate.RANK)).astype(np.float32)
    space = decontaminate.Space(np.ones(decontaminate.BUCKETS, np.float32), np.arange(1, decontaminate.BUCKETS + 1, dtype=np.int32), vectors)
    return decontaminate.Search(*decontaminate.read_items(items, space), space)


def test_word_bounds_of_regions_equal_a_plain_count():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(40)]
    search = latent_search([(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate((3, 9, 16, 30, 61))])
    chunks = [decontaminate.buckets_of(" ".join(rng.choices(vocabulary + ["other"] * 60, k=n))) for n in (0, 1, 20, 150, 700)]
    found = {(c, i): bounds for c, i, bounds in search._shared(chunks)}
    for c, ids in enumerate(chunks):
        for i, item in enumerate(search.items):
            plain = [sum(min(n, item.words[w].bit_count()) for w, n in Counter(ids[a:a + search.span[i]].tolist()).items() if w in item.words)
                     for a in range(len(ids))]
            assert ((c, i) in found) == any(p >= decontaminate.LOOSE * item.n for p in plain)
            assert (c, i) not in found or found[c, i].tolist() == plain
    assert 0 < len(found) < len(chunks) * len(search.items)


def test_texts_searched_together_have_the_leaks_of_each_alone(monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([8, 20, 60])))) for i in range(20)]
    search = latent_search(items)
    texts = ["", "...", *(" ".join(rng.choices(vocabulary, k=rng.choice([5, 80, 400])) + [items[k % 20][1]] + rng.choices(vocabulary, k=30)) for k in range(60))]
    checked = []
    plain = decontaminate.Search._check
    monkeypatch.setattr(decontaminate.Search, "_check", staticmethod(lambda item, *rest: checked.append(1) or plain(item, *rest)))
    together = search.leaks_of_all(texts)
    assert together == [search.leaks(t) for t in texts]
    assert all(k % 20 in {x["item_id"] for x in found} for k, found in enumerate(together[2:]))
    assert len(checked) / 2 < 3 * len(texts)


def test_packed_words_and_sums_of_rows_equal_plain_loops():
    rng = np.random.default_rng(14)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, decontaminate.BUCKETS, n).astype(np.int32)
        assert decontaminate.unpacked(decontaminate.packed(ids)).tolist() == ids.tolist()
    basis = rng.standard_normal((50, 7)).astype(np.float32)
    basis[0] = 0
    ids = np.minimum(rng.geometric(0.1, (6000, decontaminate.PASSAGE)) - 1, 49)
    sums, total, plain = decontaminate._sums(basis, ids), np.zeros_like(basis), np.zeros_like(basis)
    assert np.allclose(sums, basis[ids].sum(axis=1), atol=1e-4)
    decontaminate._add(total, ids, sums)
    np.add.at(plain, ids.reshape(-1), np.repeat(sums, decontaminate.PASSAGE, axis=0))
    assert np.allclose(total[1:], plain[1:], rtol=1e-3, atol=0.1) and not total[0].any()
    codes, factor = decontaminate._coded(basis)
    assert np.allclose(decontaminate._decoded(codes, factor), basis, atol=1e-4)


def test_the_space_is_fitted_on_all_passages_of_all_texts(spark, monkeypatch):
    rng = np.random.default_rng(15)
    docs = [" ".join([f"rare{k // 2}", *(f"w{int(w)}" for w in rng.exponential(60, 40))]) for k in range(decontaminate.SAMPLE + 400)]
    docs += [" ".join(f"long{k // 2}" for k in range(4000)), docs[0], docs[0], None, ""]
    items = ["w1 w2 w3 w4 w5 w6 w7 w8", "only here w9 w10 w11"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string").repartition(5)
    spaces, plain = [], decontaminate.read_items
    monkeypatch.setattr(decontaminate, "read_items", lambda rows, space: spaces.append(space) or plain(rows, space))
    decontaminate.leaks_of(df, spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string"))
    space = spaces[0]
    assert (space.place[space.weighted(decontaminate.buckets_of(" ".join(t or "" for t in docs + items)))] > 0).all()
    # all passages as rows, against the exact decomposition
    used = int(space.place.max())
    weights = np.zeros(used + 1)
    weights[space.place] = space.weights
    rows = []
    for t in [*dict.fromkeys(t or "" for t in docs), *items]:
        at = space.place[space.weighted(decontaminate.buckets_of(t))]
        for a in range(0, len(at), decontaminate.PASSAGE):
            row = np.bincount(at[a:a + decontaminate.PASSAGE], minlength=used + 1) * weights
            rows.append(row[1:] / np.sqrt((row * row).sum()))
    rows = np.array(rows)
    best = np.sort(np.linalg.eigvalsh(rows @ rows.T if len(rows) < used else rows.T @ rows))[::-1][:decontaminate.RANK].sum()
    basis = space.vectors[1:].astype(np.float64) / weights[1:, None]
    assert np.allclose(basis.T @ basis, np.eye(decontaminate.RANK), atol=0.01)
    caught = ((rows @ basis) ** 2).sum()
    print("caught", caught / best)
    assert caught >= 0.9 * best
    sent = pickle.loads(pickle.dumps(space))
    assert np.allclose(sent.vectors, space.vectors, atol=1e-4 * np.abs(space.vectors).max())


def test_recall_against_every_region_beyond_the_sample(spark):
    rng = random.Random(13)
    vocabulary = [f"w{int(k)}" for k in np.random.default_rng(13).exponential(300, 4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([10, 25, 50])))) for i in range(20)]
    docs = [(k, " ".join([f"text{k}", *rng.choices(vocabulary, k=60)])) for k in range(decontaminate.SAMPLE + 300)]
    for k in range(0, len(docs), 10):  # a paraphrase of three to nine words in ten
        loss = rng.random() * 0.6
        words = [rng.choice(vocabulary) if rng.random() < loss else w for w in items[k % 20][1].split()]
        docs[k] = (k, " ".join([docs[k][1], *words, *rng.choices(vocabulary, k=20)]))
    df, asked = (spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id")))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leak_table(df, asked).collect()}
    rows, n = decontaminate.frequencies(df)
    weights = decontaminate.weigh(rows, n, decontaminate.frequencies(asked)[1] > 0)
    space = decontaminate.Space(weights, np.arange(1, decontaminate.BUCKETS + 1, dtype=np.int32), latent_search(items).space.vectors)
    every = decontaminate.Search(*decontaminate.read_items(items, space), space)
    wanted = set()
    for d, text in docs:
        ids = space.weighted(decontaminate.buckets_of(text))
        for k, item in enumerate(every.items):
            words = ids.tolist()
            if sum(item.words[w].bit_count() for w in item.words.keys() & set(words)) >= decontaminate.LOOSE * item.n:
                spans = (words[a:a + int(every.span[k])] for a in range(len(words)))
                wanted |= {(d, item.item_id) for s in spans if decontaminate.Search._check(item, s, set(s))}
    print('recall', len(wanted & found), len(wanted))
    assert len(wanted) > 100 and len(wanted & found) >= 0.9 * len(wanted)
