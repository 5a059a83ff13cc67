"""Sharding, mixing, chats and urls against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import chat, common, mixing, sharding, url_filter


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_shards_are_even_and_numbered(spark, sf):
    rows = sharding.shard_table(table(spark, sf, "documents")).collect()
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    biggest = max(r["size"] for r in rows)
    assert max(load.values()) - min(load.values()) <= biggest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_messy_and_empty_tables(messy, nothing):
    rows = sharding.shard_table(messy).collect()
    assert len(rows) == messy.count() and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    out = sharding.shard_documents(messy)
    assert out.count() == messy.count() and out.columns.count("shard") == 1
    assert sharding.shard_table(nothing).count() == 0


def repeated(spark, null_ids=False):
    """A third of all rows is one row, in a source of its own or with null ids everywhere there."""
    rows = [(None if null_ids else 7, "one two three four five six seven eight nine ten", "hot")] * 2000
    rows += [(100 + i, "w " * (1 + i % 20), "abc"[i % 3]) for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_repeated_rows_spread_over_shards(spark):
    for null_ids in (False, True):
        docs = repeated(spark, null_ids)
        rows = sharding.shard_table(docs).collect()
        load, slots = Counter(), defaultdict(list)
        for r in rows:
            load[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert len(rows) == 6000 and len(load) == 8 and max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        whole = Counter()
        for r in sharding.shard_documents(docs).collect():
            whole[r["shard"]] += len(r["text"].encode()) + 1
        assert sum(whole.values()) == sum(load.values()) and max(whole.values()) <= 1.02 * min(whole.values())


def test_repeated_rows_meet_the_targets_of_a_mix(spark):
    for null_ids in (False, True):
        docs = repeated(spark, null_ids)
        rows = mixing.mix_table(docs).collect()
        source = {100 + i: "abc"[i % 3] for i in range(4000)}
        taken, target = Counter(), {}
        for r in rows:
            taken[source.get(r["doc_id"], "hot")] += r["taken"]
            target[source.get(r["doc_id"], "hot")] = r["target"]
            assert r["taken"] <= 3 * r["size"]
        assert len(rows) == 6000 and all(abs(taken[s] - target[s]) <= 20 for s in target)
        mixed = Counter()
        for r in mixing.mixed_documents(docs).collect():
            mixed[r["source"]] += len(r["text"].split())
        assert all(abs(mixed[s] - target[s]) <= 20 for s in target)
        assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix_table(docs.repartition(5)).collect()))


def test_counted_rows_come_back_one_by_one(spark):
    counted = spark.createDataFrame([(1, 1), (2, 3), (None, 2500), (4, 1024), (5, 1025)], "k long, n long")
    rows = [(r["k"], r["ordinal"]) for r in common.numbered(counted).collect()]
    assert sorted(rows, key=str) == sorted(((k, i) for k, n in ((1, 1), (2, 3), (None, 2500), (4, 1024), (5, 1025)) for i in range(n)), key=str)


def test_rebalancing_moves_little_and_grows(spark):
    load = spark.createDataFrame([(i, 10 + i % 7, 1) for i in range(64)], "vslot int, bytes long, rows long")
    first = sharding.first_map(spark, 64, 4)
    second = sharding.rebalance(first, load, 4)
    third = {r["vslot"]: r for r in sharding.rebalance(second, load, 5).collect()}
    was = {r["vslot"]: r["shard"] for r in second.collect()}
    moved = [v for v in third if third[v]["shard"] != was[v]]
    assert len(third) == 64 and all(third[v]["moved"] == (v in moved) for v in third)
    assert sum(third[v]["shard"] == 4 for v in moved) >= len(moved) - 4 and len(moved) < 24
    bytes_of = Counter()
    for v, r in third.items():
        bytes_of[r["shard"]] += 10 + v % 7
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 16


def filled(sizes, weights, cap):
    """Targets by sharing again and again."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(["w"] * int(rng.expovariate(0.02) + 1)), f"s{min(rng.randint(0, 6), 3)}" if i % 50 else None) for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = mixing.mix_table(docs).collect()
    size = Counter()
    for i, t, s in texts:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, filled([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3)))
    source = {i: s for i, _, s in texts}
    taken = Counter()
    for r in rows:
        assert math.isclose(r["target"], want[source[r["doc_id"]]], rel_tol=1e-12) and r["source_size"] == size[source[r["doc_id"]]]
        assert r["taken"] % max(r["size"], 1) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(400, 0.02 * want[s]) for s in names)
    assert {tuple(r) for r in rows} == {tuple(r) for r in mixing.mix_table(docs.repartition(7)).collect()}


def test_multipliers_solve_the_dual(spark):
    sizes = [(("a"), n, 5) for n in (1, 2, 3, 50, 400)] + [("b", n, 9) for n in (10, 20, 30)]
    table_ = spark.createDataFrame(sizes, "source string, size long, n long")
    solved = mixing.solve(table_, mixing.source_targets(table_), tolerance=1e-9).collect()
    for r in solved:
        if r["lam"] is not None:
            got = sum(n * s * min(3, math.exp(r["lam"] * s / r["scale"])) for x, s, n in sizes if x == r["source"])
            assert math.isclose(got, r["target"], rel_tol=1e-8)


def test_mix_of_messy_and_empty_tables(messy, nothing):
    rows = mixing.mix_table(messy).collect()
    assert len(rows) == messy.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mixed_documents(messy).columns == messy.columns
    assert mixing.mix_table(nothing).count() == 0


def fold(events):
    """Messages of one conversation by walking through its log."""
    order = {k: i for i, k in enumerate(chat.KINDS)}
    texts, roles, first = {}, {}, {}
    for seq, message, kind, role, text in sorted(events, key=lambda e: (e[0], order[e[2]], e[3], e[4])):
        first.setdefault(message, seq)
        roles.setdefault(message, role)
        texts[message] = None if kind == "delete" else (texts.get(message) or "") + text if kind == "delta" else text
    return [(roles[m], texts[m]) for m in sorted(first, key=lambda m: (first[m], m)) if texts[m] is not None]


def test_chat_logs_fold_and_round_trip(spark):
    rng, rows = random.Random(5), []
    parts = ["a", "\\", "</turn>", "\\l", "<turn user>", "\n", "é", "\\b", ">", " "]
    for c in range(30):
        for s in range(rng.randint(1, 25)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            rows.append((c, s, rng.randint(0, 4), kind, rng.choice(["user", "assistant", "<odd>\n\\"]), "".join(rng.choices(parts, k=rng.randint(0, 6)))))
    events = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string")
    shown = chat.format_chats(events.repartition(5))
    for r in chat.read_back(shown).collect():
        want = fold([e[1:] for e in rows if e[0] == r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert list(r["losses"]) == [t for role, t in want if role == "assistant"]
    for r in shown.collect():
        for s in r["spans"]:
            assert r["formatted"][s["start"]:s["end"]].endswith(chat.CLOSE)


def test_deleted_messages_stay_out(spark):
    rows = [(1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "user", "oops"), (1, 2, 2, "delete", None, None)]
    events = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string")
    assert [[t["text"] for t in r["turns"]] for r in chat.read_back(chat.format_chats(events)).collect()] == [["hi"]]


def test_chat_table_of_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "y"), (2, 1, "assistant", "z" * 200_000)]
    got = {r["conv_id"]: r for r in chat.chat_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"\nx\nuser\n\nuser\n\n").hexdigest()
    assert got[2]["loss_chars"] == 200_000 and got[None]["loss_sha256"] == hashlib.sha256(b"y").hexdigest()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_table(empty).count() == 0


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host):])[0]


def test_urls_follow_rules_and_model(spark, sf):
    odd = [None, "", "x", "HTTP://EXAMPLE.NET", "a://b.example.net/en/?q", "://", "u://org/fr/#é", "u://xorg/fr/", "u://a.net/\nb", "u://example.com/de/" + "x" * 50_000]
    urls = [r["url"] for r in table(spark, sf, "pages").collect()] + odd * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("kind", F.lit(1)).withColumn("url_host", F.lit(1))
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    rules, labels = dict(url_filter.RULES), {}
    for i, u in enumerate(urls):
        host, path = split_url(u)
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (got[i]["url_host"], got[i]["url_path"], got[i]["url_rule"]) == (host, path, rule)
        labels[i] = rules.get(rule)
        assert rule is None or got[i]["url_verdict"] == rules[rule]
    # the model, with dictionaries
    texts = {(u or "").lower() for u in urls} - {""}
    held = {r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").where("pmod(xxhash64(t), 5) = 0").collect()}
    n = {m: [Counter() for _ in range(6)] for m in ("allow", "block")}
    pad = lambda t: url_filter.PAD * 4 + t + url_filter.END
    for i, u in enumerate(urls):
        t = (u or "").lower()
        if labels[i] and t not in held and t:
            for p in range(4, len(pad(t))):
                for k in range(5):
                    n[labels[i]][k][pad(t)[p - k:p + 1]] += 1
    context = {m: [Counter() for _ in range(5)] for m in n}
    for m in n:
        for k in range(5):
            for g, c in n[m][k].items():
                context[m][k][g[:-1]] += c

    def chance(m, g):
        p = (n[m][0][g[-1]] + 0.5) / (context[m][0][""] + 128)
        for k in range(1, 5):
            p = (n[m][k][g[4 - k:]] + 4 * p) / (context[m][k][g[4 - k:4]] + 4)
        return p

    for i in list(range(40)) + [len(urls) - 2]:
        t = pad((urls[i] or "").lower())
        want = sum(math.log(chance("allow", t[p - 4:p + 1]) / chance("block", t[p - 4:p + 1])) for p in range(4, len(t))) / (len(t) - 4)
        assert abs(got[i]["url_score"] - want) < 1e-6
    kept = url_filter.kept_pages(pages)
    assert kept.columns == pages.columns and kept.count() == sum(r["url_verdict"] == "allow" for r in got.values())


def test_urls_of_an_empty_table(spark):
    assert url_filter.url_table(spark.createDataFrame([], "page_id long, url string")).count() == 0
