import random
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.llm import source_audit, token_align
from tidemark.llm.token_align import TOKENIZERS, common_ends, gallop


def plain_alignment(texts):
    """Rows of the contract by plain loops, with the library of the published file for tokenizer A."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    of = token_align.entry_bytes()
    docs, held = [], Counter()
    for text in texts:
        groups = []
        if text:
            left = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            right = [(i, token_align.piece_bytes(b.id_to_piece(i), b.is_byte(i))) for i in b.encode(text)]
            whole = (" " + text).encode()
            if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right):
                ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (left, right)]
                cuts = sorted(ends[0] & ends[1])
                for side in (left, right):
                    at, k, split = 0, 0, [[] for _ in cuts]
                    for i, x in side:
                        at += len(x)
                        while at > cuts[k]:
                            k += 1
                        split[k].append(i)
                    groups.append(split)
                groups = list(zip(*groups))
        docs.append(groups)
        held.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        digest = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(held[k] == top[k[0]] for k in links), sum(held[k] for k in links), sha256(digest.encode()).hexdigest() if groups else ""))
    return out


@pytest.fixture(scope="module")
def awkward():
    draw = random.Random(4)
    letters = "abcdeé ßñ中文 \n\t　🙂0123<>|'s̀"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 200))) for _ in range(150)]
    return [*texts, *texts[:30], None, "", " ", "  two", "tail ", "▁under", "<|endoftext|> and <s> </s> <unk> <0x41>", "🙂" * 300, "word " * 3000, "é" * 2000]


def test_gallop_equals_a_search():
    draw = np.random.default_rng(1)
    for n, m, block in ((0, 5, 4), (5, 0, 4), (300, 40, 7), (40, 3000, 16), (1, 1, 1)):
        a, b = (np.unique(draw.integers(0, 4000, k)) for k in (n, m))
        assert gallop(a, b, block).tolist() == np.searchsorted(b, a).tolist()
        x, y = common_ends(a, b)
        assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@pytest.mark.parametrize("frequent", [400_000, 50, 0])
def test_alignment_equals_plain_loops(spark, awkward, frequent):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(awkward)], "doc_id long, text string, count string").repartition(5)
    found = token_align.stored(token_align.aligned(docs, most=5000), "test-align")
    got = sorted(token_align.scored(found, frequent).drop("row_id").collect(), key=lambda r: r["doc_id"])
    keep = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert [tuple(r[c] for c in keep) for r in got] == plain_alignment(awkward)


def test_alignment_of_messy_rows(spark, messy, nothing):
    rows = token_align.align_table(messy).collect()
    texts = [r["text"] for r in messy.select("text").collect()]
    want = Counter(plain_alignment(texts))
    assert Counter(tuple(r)[1:] for r in rows) == want
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in messy.collect())
    assert token_align.align_table(nothing).collect() == []


def audited(rows):
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    return sorted(duckdb.sql(source_audit.SQL).fetchall())


def test_audit_equals_the_sql_over_spilled_runs(spark):
    draw = random.Random(7)
    words = [f"{c}{d}" for c in "abcdéñ中Z" for d in ("x", "Y", "zz", "é")]
    rows = [(i, " ".join(draw.choice(words[: draw.randint(2, 32)]) for _ in range(draw.randint(0, 30))), draw.choice(["en", "de", None]),
             draw.choice(["one", "two", "three", None, "", "q\0\n"])) for i in range(600)]
    rows += [(None, None, "fr", "a"), (1, "", "fr", "b"), (1, "rare", "fr", None), (2, "lone", "xx", "only")]
    rows += [(9, "copied words twice twice", "en", "one")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("value", source_audit.F.lit("x")).repartition(6)
    kept = source_audit.divergence(docs, entries=40, shard_bytes=500, fan_in=3)
    assert sorted(map(tuple, kept.collect())) == audited(rows)


def test_audit_of_awkward_tables(spark, messy, nothing):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in messy.collect()]
    assert sorted(map(tuple, source_audit.audit_table(messy).collect())) == audited(rows)
    assert source_audit.audit_table(nothing).collect() == []


def test_pair_corrections_over_many_sources(spark):
    rows = [(i, f"same word{i % 7} other{i % 3}", "en", f"s{i % 12:02}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, source_audit.divergence(docs).collect())) == audited(rows)


def test_shares_are_exact_for_large_counts(spark):
    n, total = 9_000_000_000_000, 9_000_000_000_123
    got = spark.range(1).select(source_audit.share(source_audit.F.lit(n), source_audit.F.lit(total)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // total
