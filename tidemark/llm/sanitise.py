"""Sanitisation of personal data by what terms disclose, with DataFrame functions only.

Protected entities are e-mail addresses, IP addresses, card and phone numbers. For each one the
corpus says which terms give it away: among N different texts an entity e stands in n(e), a
term t in n(t), and in c texts t stands among the ``NEAR`` terms before or after e. With
pointwise mutual information log(c N / (n(e) n(t))) and the information of the entity log(N / n(e)),
their ratio is the disclosure of e by t: 1 when t stands only near e, lower the more often t is
seen elsewhere, below 0 for words that everybody uses. A term that discloses some entity by ``GENERAL`` or more is
generalised in every text, by ``REMOVE`` or more it is removed, if at least ``SUPPORT`` texts show it.

A context is linear in the text, so no pairs of all entities and all terms of a document are formed.
Only terms that could still reach the threshold, judged by how often contexts show them, are counted in the
whole corpus. Spans come from cutting a text at the matches of a pattern: the lengths of the
pieces and matches add up to the starts. The patterns are possessive, so each reads a text in linear time.

Defined results: a null or empty text has no spans; copies of a text count once as evidence and have
equal spans; an entity in more than half of all texts is public and guards no term; digits are no terms; a
term that overlaps a span of the base kinds is left to that span; spans count code points; an empty table
gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attach_salted, stored

NEAR = 8
REACH = 256
SUPPORT = 3
GENERAL, REMOVE = 0.95, 0.99
BLOCK = 256
# The base patterns, made possessive, with their checks of digits; letters of a term.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = (*PATTERNS, "general", "remove")
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def running(lengths: Column) -> Column:
    """Running sums of an array of numbers. Blocks keep the copying of the growing array small."""
    none = F.array().cast("array<int>")

    def add(a: Column, v: Column) -> Column:
        total = a["total"] + v
        return F.struct(total.alias("total"), F.concat(a["out"], F.array(total)).alias("out"))

    def block(a: Column, b: Column) -> Column:
        part = F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), F.struct(a["total"].alias("total"), none.alias("out")), add)
        return F.transform(F.array(part), lambda k: F.struct(k["total"].alias("total"), F.concat(a["out"], k["out"]).alias("out")))[0]

    blocks = F.sequence(F.lit(0), ((F.size(lengths) - 1) / BLOCK).cast("int"))
    start = F.struct(F.lit(0).alias("total"), none.alias("out"))
    return F.when(F.size(lengths) == 0, none).otherwise(F.aggregate(blocks, start, block, lambda a: a["out"]))


def starts(pieces: Column, matches: Column) -> Column:
    """Where each match begins, from the pieces between the matches."""
    lengths = F.transform(matches, lambda m, i: F.char_length(pieces[i]) + F.when(i > 0, F.char_length(matches[i - 1])).otherwise(0))
    return running(lengths)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the weighted digit sum of a string of digits is a multiple of ten."""
    back = F.split(F.reverse(digits), "")
    doubled = F.transform(back, lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))) <= F.when(F.ltrim(p, F.lit("0")) <= "255", 3).otherwise(2))
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with ``found``: the checked base spans by start and kind, each with the value and its surroundings."""
    out = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        seen = F.col("_t").rlike(pattern)
        if SIGNS[kind]:
            seen = F.col("_t").contains(SIGNS[kind]) & seen
        out = out.withColumn(f"_s_{kind}", seen)
    out = out.select("*", *[F.when(F.col(f"_s_{k}"), F.regexp_extract_all("_t", F.lit(p), F.lit(0))).otherwise(none).alias(f"_m_{k}") for k, p in PATTERNS.items()],
                     *[F.when(F.col(f"_s_{k}"), F.split("_t", p, -1)).otherwise(none).alias(f"_p_{k}") for k, p in PATTERNS.items()])
    out = out.select("*", *[starts(F.col(f"_p_{k}"), F.col(f"_m_{k}")).alias(f"_a_{k}") for k in PATTERNS])

    def spans(number: int, kind: str) -> Column:
        matches, pieces = F.col(f"_m_{kind}"), F.col(f"_p_{kind}")
        all_of = F.transform(F.col(f"_a_{kind}"), lambda at, i: F.struct(
            at.alias("start"), F.lit(number).alias("kind"), (at + F.char_length(matches[i])).alias("end"), matches[i].alias("value"),
            F.right(pieces[i], F.lit(REACH)).alias("before"), F.left(pieces[i + 1], F.lit(REACH)).alias("after")))
        return F.filter(all_of, lambda s: _holds(kind, s["value"]))

    found = F.array_sort(F.concat(*[spans(i, k) for i, k in enumerate(PATTERNS)]))
    return out.select(*docs.columns, found.alias("found"))


def _terms(context: Column, before: bool, near: int) -> Column:
    """The terms of a context that are nearest, e-mail addresses left out; a term cut by its far edge isn't taken."""
    edge = f"^{LETTERS}+" if before else f"{LETTERS}+$"
    whole = F.when(F.char_length(context) == REACH, F.regexp_replace(context, edge, "")).otherwise(context)
    terms = F.regexp_extract_all(F.regexp_replace(lowered(whole), EMAIL, " "), F.lit(f"{LETTERS}+"), F.lit(0))
    return F.slice(terms, F.greatest(F.size(terms) - near + 1, F.lit(1)), near) if before else F.slice(terms, 1, near)


def contexts(texts: DataFrame, near: int = NEAR) -> DataFrame:
    """(key, entity, terms) of every protected entity of a text."""
    rows = texts.select("key", F.explode("found").alias("s")).select("key", "s.*")
    value = F.when(F.col("kind") == 0, lowered(F.col("value"))).when(F.col("kind") == 1, F.col("value")).otherwise(_digits(F.col("value")))
    near_terms = F.array_union(_terms(F.col("before"), True, near), _terms(F.col("after"), False, near))
    return rows.select("key", F.concat_ws(":", "kind", value).alias("entity"), near_terms.alias("terms"))


def disclosure(both: Column, entity: Column, term: Column, texts: Column) -> Column:
    """Mutual information of term and entity as a share of the information of the entity."""
    return F.log2(both.cast("double") * texts / (entity.cast("double") * term)) / F.log2(texts / entity.cast("double"))


def disclosing_terms(docs: DataFrame, texts: DataFrame, n: int, near: int = NEAR, support: int = SUPPORT, least: float = GENERAL) -> tuple[DataFrame, DataFrame]:
    """((term, rate) of the terms that disclose some entity by ``least`` or more, (key, term) of the texts that hold a term which might).

    docs has key and text, texts one row (key, found) per different text with base spans, n counts all different texts."""
    near_rows = stored(contexts(texts, near), "pii-contexts")
    of_entity = near_rows.select("key", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    guarded = of_entity.where(F.col("n_entity") * 2 <= n)
    told = near_rows.select("key", "entity", F.explode("terms").alias("term")).distinct()
    both = told.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    beside = told.select("key", "term").distinct()
    seen = beside.groupBy("term").agg(F.count(F.lit(1)).alias("n_seen"))
    total = F.lit(float(n))
    bound = both.join(guarded, "entity").join(seen, "term").where(disclosure(F.col("both"), F.col("n_entity"), F.col("n_seen"), total) >= least)
    pairs = stored(bound.select("entity", "term", "both", "n_entity"), "pii-pairs")
    wanted = stored(pairs.select("term").distinct(), "pii-candidates")
    words = docs.select("key", F.explode(F.array_distinct(F.regexp_extract_all(lowered(F.col("text")), F.lit(f"{LETTERS}+"), F.lit(0)))).alias("term"))
    whole = attach_salted(words, wanted, ["term"], F.col("key"))
    held = stored(whole.unionByName(attach_salted(beside, wanted, ["term"], F.col("key"))).distinct(), "pii-held")
    of_term = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    rates = pairs.join(of_term, "term").withColumn("rate", disclosure(F.col("both"), F.col("n_entity"), F.col("n_term"), total))
    return rates.groupBy("term").agg(F.max("rate").alias("rate")).where(F.col("rate") >= least), held


def term_spans(docs: DataFrame, flagged: DataFrame, held: DataFrame) -> DataFrame:
    """(key, start, kind, end) of the flagged terms in the texts that hold them; docs has key and text."""
    keys = stored(held.join(flagged, "term", "left_semi").select("key").distinct(), "pii-keys")
    low = attach_salted(docs, keys, ["key"], F.monotonically_increasing_id()).select("key", lowered(F.col("text")).alias("text"))
    cut = low.select("key", F.regexp_extract_all("text", F.lit(f"{LETTERS}+"), F.lit(0)).alias("m"), F.split("text", f"{LETTERS}+", -1).alias("p"))
    rows = cut.select("key", F.explode(F.arrays_zip(starts(F.col("p"), F.col("m")).alias("start"), F.col("m").alias("term"))).alias("w")).select("key", "w.*")
    kind = F.when(F.col("rate") >= REMOVE, KINDS.index("remove")).otherwise(KINDS.index("general"))
    marked = attach_salted(rows, flagged, ["term"], F.col("key"))
    return marked.select("key", "start", kind.alias("kind"), (F.col("start") + F.char_length("term")).alias("end")).distinct()


def outside(extra: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, extra): per text the spans of terms that touch no base span, in order."""
    touched = texts.join(extra.select("key").distinct(), "key", "left_semi")
    base = touched.select("key", F.explode("found").alias("s")).select("key", "s.start", "s.kind", "s.end")
    is_base = F.col("kind") < len(PATTERNS)
    order = Window.partitionBy("key").orderBy("start", "kind", "end")
    rows = base.unionByName(extra).select(
        "*", F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("reach"),
        F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("next"))
    free = rows.where(~is_base & F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    return free.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("extra"))


def spotted(docs: DataFrame, near: int = NEAR, support: int = SUPPORT, least: float = GENERAL) -> DataFrame:
    """docs without text, with ``spans``: all spans (start, kind, end), kind as its place in KINDS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    rest = [c for c in docs.columns if c != "text"]
    own = docs.select(F.struct(*rest).alias("_row"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    base = stored(base_spans(own).drop("text"), "pii-base")
    n = base.agg(F.count_distinct("key")).first()[0]
    texts = stored(base.where(F.size("found") > 0).groupBy("key").agg(F.first("found").alias("found")), "pii-texts")
    flagged, held = disclosing_terms(keyed, texts, n, near, support, least)
    flagged = stored(flagged, "pii-terms")
    extra = stored(outside(term_spans(keyed, flagged, held), texts), "pii-extra")
    joined = attach_salted(base, extra, ["key"], F.monotonically_increasing_id(), "left")
    plain = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return joined.select("_row.*", F.array_sort(F.concat(plain, F.coalesce("extra", none))).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by their kind in brackets, generalised terms by their first letter, removed terms by nothing.
    Of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"[{k}]") for k in PATTERNS])

    def step(a: Column, s: Column) -> Column:
        shown = F.when(s["kind"] < len(PATTERNS), names[s["kind"]]).when(
            s["kind"] == KINDS.index("general"), F.concat(F.substring(text, s["start"] + 1, 1), F.lit("…"))).otherwise("")
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        put = F.struct(F.concat(a["out"], F.array(gap, shown)).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= a["at"], put).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    return F.transform(F.array(F.aggregate(spans, start, step)), lambda k: F.concat(F.array_join(k["out"], ""), F.substring(text, k["at"] + 1, F.char_length(text))))[0]


def _digest(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def private_table(docs: DataFrame) -> DataFrame:
    """Per document the numbers of base matches, the digest of the base spans and all spans."""
    found = spotted(docs.select("doc_id", "text"))

    def count(number: int, kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")

    counts = [count(i, k) for i, k in enumerate(PATTERNS)]
    base = F.filter("spans", lambda s: s["kind"] < len(PATTERNS))
    return found.select("doc_id", *counts, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))
