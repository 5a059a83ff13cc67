"""URL filter: host rules first, then a ratio of two character language models.

Urls that a rule accepts or rejects train one Markov model each over the characters of
the lower-cased url, with contexts of 0 to 4 characters; a longer context is smoothed
with the estimate of the next shorter one. The score of a url is the difference of the
two log-likelihoods per character. The limit is set where held-out ruled urls (one in
five, by hash) are told apart best, and decides the urls no rule fits.

Counts are sums with partial results over every url of the table; their table has one row
per distinct five characters. Score tables are broadcast only after a count.

Defined results: a null url and one without ``://`` have empty host and path and fit no rule;
an empty url has no score and is allowed; with no ruled urls of one kind the limit is 0;
repeated rows and ids are judged alike; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attach, stored
from tidemark.session import parallelism

#: (rule, verdict): host, then path from the first slash on (fixed values).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEPTH = 4
KAPPA = 4.0
FOLDS = 5
ALPHABET = 256
STEP = 0.01
PAD, END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, or null."""
    fitting = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fitting.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*fitting)


def grams(text: Column, depth: int = DEPTH) -> Column:
    """Every character of the text, and its end, behind the ``depth`` characters before it."""
    chars = F.array_append(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(END))
    # the characters as one element of an array, so that they are split once and not once per character
    return F.transform(F.array(chars), lambda own: F.transform(own, lambda c, i: F.concat(
        *[F.when(i >= k, F.get(own, i - k)).otherwise(PAD) for k in range(depth, 0, -1)], c)))[0]


def count_grams(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, a, r): how often accepted and rejected texts have it; texts with null ``kind`` add the gram only."""
    n = F.col("n").cast("long")
    each = texts.select("kind", "n", F.explode(grams(F.col("text"), depth)).alias("gram"))
    return each.groupBy("gram").agg(
        F.sum(F.when(F.col("kind") == "allow", n).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("kind") == "block", n).otherwise(0)).alias("r"))


def gram_scores(counts: DataFrame, depth: int = DEPTH, kappa: float = KAPPA) -> DataFrame:
    """(gram, llr): log of the smoothed chance of the last character under either model."""
    all_a, all_r = counts.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
    last = stored(counts.groupBy(F.right("gram", F.lit(1)).alias("_c")).agg(F.sum("a").alias("_a"), F.sum("r").alias("_r")), "url-letters")
    # the chance of a letter without context
    df = attach(counts.withColumn("_c", F.right("gram", F.lit(1))), last, "_c")
    df = df.withColumns({"pa": (F.col("_a") + 0.5) / (all_a + 0.5 * ALPHABET), "pr": (F.col("_r") + 0.5) / (all_r + 0.5 * ALPHABET)})
    for k in range(1, depth + 1):
        tail = Window.partitionBy(F.right("gram", F.lit(k + 1)))
        context = Window.partitionBy(F.substring("gram", depth + 1 - k, k))
        sums = {f"_{m}{w}": F.sum(m).over(over) for m in "ar" for w, over in (("t", tail), ("c", context))}
        df = df.withColumns(sums).withColumns({
            f"p{m}": (F.col(f"_{m}t") + kappa * F.col(f"p{m}")) / (F.col(f"_{m}c") + kappa) for m in "ar"})
    return df.select("gram", F.log(F.col("pa") / F.col("pr")).alias("llr"))


def text_scores(texts: DataFrame, scores: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(text, score): mean over the characters of each distinct text."""
    each = texts.select("text", F.explode(grams(F.col("text"), depth)).alias("gram"))
    mean = F.sum(F.col("llr").cast("decimal(30,12)")).cast("double") / F.count(F.lit(1))
    return attach(each, scores, "gram").groupBy("text").agg(F.round(mean, 9).alias("score"))


def limit_of(judged: DataFrame, step: float = STEP) -> float:
    """The score that separates held-out accepted and rejected texts best; one row per step of the score."""
    bins = judged.groupBy(F.floor(F.col("score") / step).cast("long").alias("bin")).agg(
        F.sum(F.when(F.col("kind") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("kind") == "block", F.col("n")).otherwise(0)).alias("r"))
    total = Window.partitionBy()
    below = Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    gain = (F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(total)
            - F.coalesce(F.sum("a").over(below), F.lit(0)) / F.nullif(F.sum("a").over(total), F.lit(0)))
    best = bins.where("a + r > 0").withColumn("gain", F.when(F.sum("r").over(total) > 0, gain)).where("gain IS NOT NULL").orderBy(
        F.desc("gain"), F.abs(F.col("bin")), "bin").first()
    return 0.0 if best is None else best["bin"] * step


def judge(pages: DataFrame, rules=RULES, depth: int = DEPTH) -> DataFrame:
    """pages with url_host, url_path, url_rule, url_score and url_verdict (columns of these names are replaced)."""
    pages = pages.drop(*[f"url_{c}" for c in ("host", "path", "rule", "score", "verdict")])
    url = F.col("url")
    verdicts = F.create_map(*[F.lit(x) for pair in rules for x in pair])
    parsed = pages.select(*pages.columns, F.lower(F.coalesce(url, F.lit(""))).alias("_text"),
                          host_of(url).alias("_host"), path_of(url).alias("_path"))
    parsed = parsed.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    parsed = parsed.withColumn("_kind", F.get(F.map_values(F.map_filter(verdicts, lambda k, _: k == F.col("_rule"))), 0))
    held = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    # texts that rules judge both ways, by the case of their letters, count for both
    texts = parsed.where("_text <> ''").groupBy(F.col("_text").alias("text"), F.col("_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    # small rows, much work for each: a file for every task
    texts = stored(texts.repartition(parallelism(pages.sparkSession)), "url-texts")
    counts = stored(count_grams(texts.withColumn("kind", F.when(~held, F.col("kind"))), depth), "url-grams")
    model = stored(gram_scores(counts, depth), "url-model")
    scores = stored(text_scores(texts.select("text").distinct(), model, depth), "url-scores")
    limit = limit_of(texts.where(held & F.col("kind").isNotNull()).join(scores, "text"))
    out = parsed.join(scores.select(F.col("text").alias("_t"), F.col("score").alias("_score")), F.col("_text") == F.col("_t"), "left")
    said = F.coalesce("_kind", F.when(F.col("_score") < limit, "block").otherwise("allow"))
    return out.select(*pages.columns, *[F.col(f"_{c}").alias(f"url_{c}") for c in ("host", "path", "rule", "score")], said.alias("url_verdict"))


def kept_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    own = F.struct(*pages.columns).alias("_page")
    return judge(pages.select(own, "url"), rules).where("url_verdict = 'allow'").select("_page.*")


def url_table(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select(
        "page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"),
        F.col("url_verdict").alias("verdict"), F.col("url_score").alias("score"))
