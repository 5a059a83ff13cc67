import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import sanitise
from tidemark.llm.sanitise import GENERAL, KINDS, NEAR, REACH, REMOVE, SUPPORT

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain_base(text):
    return sorted((m.start(), k, m.end()) for k, name in enumerate(PLAIN) for m in re.finditer(PLAIN[name], text) if holds(name, m.group()))


def plain_all(texts):
    """Base spans and disclosing terms of all texts by plain loops."""
    texts = [t or "" for t in texts]
    distinct, n_entity, told, near_of = set(texts), defaultdict(set), defaultdict(set), defaultdict(set)
    for text in distinct:
        for k, name in enumerate(PLAIN):
            at = [(m.start(), m.end()) for m in re.finditer(PLAIN[name], text)]
            if name == "card":  # context reaches to the next run of 12 to 19 digits
                at = [(a, b) for a, b in at if 12 <= len(re.sub("[^0-9]", "", text[a:b])) <= 19]
            for i, (a, b) in enumerate(at):
                value = text[a:b]
                if not holds(name, value):
                    continue
                entity = f"{k}:" + (value.translate(LOWER) if k == 0 else value if k == 1 else re.sub("[^0-9]", "", value))
                before, after = text[at[i - 1][1] if i else 0:a][-REACH:], text[b:at[i + 1][0] if i + 1 < len(at) else None][:REACH]
                before = re.sub(f"^{TERM}", "", before) if len(before) == REACH else before
                after = re.sub(f"{TERM}$", "", after) if len(after) == REACH else after
                terms = [re.findall(TERM, re.sub(PLAIN["email"], " ", x.translate(LOWER))) for x in (before, after)]
                n_entity[entity].add(text)
                for term in set(terms[0][-NEAR:] + terms[1][:NEAR]):
                    told[entity, term].add(text)
                    near_of[term].add(text)
    holding = defaultdict(set)
    for text in distinct:
        for term in set(re.findall(TERM, text.translate(LOWER))):
            holding[term].add(text)
    rate = {}
    for (entity, term), both in told.items():
        e, t, n = len(n_entity[entity]), len(holding[term] | near_of[term]), len(distinct)
        if len(both) >= SUPPORT and e * 2 <= n:
            r = math.log2(len(both) * n / (e * t)) / math.log2(n / e)
            rate[term] = max(r, rate.get(term, -9))
    out = []
    for text in texts:
        spans = plain_base(text)
        extra = [(m.start(), 5 if rate[m.group()] >= REMOVE else 4, m.end()) for m in re.finditer(TERM, text.translate(LOWER))
                 if rate.get(m.group(), -9) >= GENERAL]
        spans += [x for x in extra if all(x[2] <= a or x[0] >= b for a, _, b in spans)]
        out.append(sorted(spans))
    return out


def contract(spans):
    base = [s for s in spans if s[1] < 4]
    text = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x) for x in (base, spans)]
    kinds = Counter(k for _, k, _ in base)
    return (*[kinds[k] for k in range(4)], sha256(text[0].encode()).hexdigest(), text[1])


def corpus():
    draw = random.Random(11)
    common = "the of and über mail call write number from é".split()
    people = [(f"Name{chr(97 + i)}xy", f"p{i}.q+r@mail{i}.example.com", f"+1 (5{i}0) 555-01{i}{i}", f"4111 1111 1111 11{i}1", f"10.{i}.0.25{i % 6}") for i in range(5)]
    texts = []
    for k in range(240):
        words = [draw.choice(common) for _ in range(draw.randint(5, 60))]
        if k % 3 == 0:
            person = draw.choice(people)
            at = draw.randint(0, len(words))
            words[at:at] = [person[0], person[1], draw.choice(person[2:])]
        if k % 40 == 1:
            words.insert(draw.randint(0, len(words)), draw.choice(people[:3])[0].upper())
        texts.append(" ".join(words) + f" {k}")
    odd = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 0255.001.1.1", "+1 ((( 5", "éfoo@x.com foo@x", "x@y.z@w.v 5 4-1 1 1-1 1 1 1 1 1 1 1 1 1 1 1 1", "word4111111111111111end",
           "4111-1111-1111-1111", "49927398716 79927398713", "🙂 a@b.cd 🙂 +49 (30) 1234.5678 -", None, "", "y." * 400 + "z@b" + ".c" * 500]
    return texts + texts[:40] + odd


def test_spans_equal_plain_loops(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in sanitise.private_table(docs).collect()}
    want = [contract(s) for s in plain_all(texts)]
    assert [got[i] for i in range(len(texts))] == want
    assert sum("remove" in w[-1] for w in want) > 20 and sum("general" in w[-1] for w in want) > 5


def test_spans_equal_plain_loops_without_broadcast(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    texts = corpus()[:120]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
    assert Counter(tuple(r)[1:] for r in sanitise.private_table(docs).collect()) == Counter(contract(s) for s in plain_all(texts))


def test_awkward_tables(spark, messy, nothing):
    texts = [r["text"] for r in messy.select("text").collect()]
    got = Counter(tuple(r)[1:] for r in sanitise.private_table(messy).collect())
    assert got == Counter(contract(s) for s in plain_all(texts))
    assert sanitise.private_table(nothing).collect() == []
    kept = sanitise.spotted(messy)
    assert kept.columns == [c for c in messy.columns if c != "text"] + ["spans"]


@pytest.fixture(scope="module")
def base(spark):
    def run(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = sanitise.base_spans(docs).select("doc_id", F.expr("transform(found, s -> struct(s.start, s.kind, s.end)) AS s")).collect()
        return [[tuple(x) for x in r["s"]] for r in sorted(rows, key=lambda r: r["doc_id"])]
    return run


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab1290.@+-_ ()%é\n", max_size=60), min_size=30, max_size=80))
def test_base_spans_equal_the_patterns(base, texts):
    assert base(texts) == [plain_base(t) for t in texts]


def test_many_spans_of_a_long_text(base):
    parts = [f"u{i}@h{i}.org" for i in range(20_000)]
    at = [0]
    for p in parts:
        at.append(at[-1] + len(p) + 1)
    mails = [(a, 0, a + len(p)) for a, p in zip(at, parts)]
    addresses = [(8 * i, 1, 8 * i + 7) for i in range(25_000)]
    assert base([" ".join(parts), "z" * 500_000, "1." * 100_000, "+1" + "(" * 200_000]) == [mails, [], addresses, []]


def test_sanitised_text(spark):
    docs = spark.createDataFrame([("Annex of a0b@c.de, see",)], "text string")
    spans = F.expr("array(named_struct('start', 0, 'kind', 4, 'end', 5), named_struct('start', 9, 'kind', 0, 'end', 17), named_struct('start', 12, 'kind', 2, 'end', 15), "
                   "named_struct('start', 19, 'kind', 5, 'end', 22))")
    assert docs.select(sanitise.sanitised(F.col("text"), spans)).first()[0] == "A… of [email], "
