"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines that are not blank is hashed (128 bits). Windows
that occur at more than one place are found globally from the first and last place of
each hash, which is summed before it is shuffled. All windows but the first of a hash, in the
order of (doc_id, text, line), cover their lines; covered lines that touch are merged
into ranges and cut out of the text. A line is only cut where an equal line stays at an
earlier place.

Lines are compared without spaces at their ends. Defined results: a null text stays null;
texts with fewer than three non-blank lines stay as they are; blank lines inside a covered
window go with it; rows that repeat both id and text are one document and are treated
alike; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attach, stored

WIDTH = 3
KEY = ["doc_id", "_text"]


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, _text, first, last, h1, h2) of every window; ``_text`` is a hash of the text."""
    full = F.filter(
        F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), F.trim(line).alias("line"))),
        lambda x: x["line"] != "")
    lined = docs.select("doc_id", F.xxhash64("text").alias("_text"), full.alias("ls")).where(F.size("ls") >= width)

    def window(j: Column) -> Column:
        own = [F.get("ls", j + k)["line"] for k in range(width)]
        return F.struct(F.get("ls", j)["i"].alias("first"), F.get("ls", j + width - 1)["i"].alias("last"),
                        F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(width), *own).alias("h2"))

    return lined.select(*KEY, F.inline(F.transform(F.sequence(F.lit(0), F.size("ls") - width), window)))


def repeated_ranges(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, _text, ranges): merged line ranges (a, b) that repeat an earlier place."""
    found = stored(windows(docs, width), "line-windows")
    place = F.struct(*KEY, "first")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("origin"), F.max(place).alias("_end")).where(
        ~F.col("origin").eqNullSafe(F.col("_end"))).drop("_end")
    later = attach(found, stored(repeated, "line-repeats"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("origin")))
    order = Window.partitionBy(*KEY).orderBy("first")
    spans = later.select(*KEY, "first", "last").distinct()
    spans = spans.withColumn("_new", (F.col("first") > F.lag("last").over(order) + 1).cast("int"))
    spans = spans.withColumn("_island", F.sum(F.coalesce("_new", F.lit(0))).over(order))
    merged = spans.groupBy(*KEY, "_island").agg(F.min("first").alias("a"), F.max("last").alias("b"))
    return merged.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("ranges"))


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the text cut, and the cut ranges as ``line_ranges`` (empty where nothing was cut)."""
    names = [c for c in docs.columns if c != "line_ranges"]  # a column of that name is replaced
    cut = stored(repeated_ranges(docs, width), "line-ranges").select(
        F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), F.col("ranges").alias("_ranges"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    lines = F.split("text", "\n")

    def between(k: Column) -> Column:
        start = F.coalesce(F.get("_ranges", k - 1)["b"] + 1, F.lit(0))
        return F.slice("_lines", start + 1, F.coalesce(F.get("_ranges", k)["a"], F.size("_lines")) - start)

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_ranges")), between)), "\n")
    out = attach(docs, cut, same, "left").withColumn("_lines", F.when(F.col("_ranges").isNotNull(), lines))
    return out.select(
        *[F.when(F.col("_ranges").isNotNull(), kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in names],
        F.coalesce("_ranges", F.array().cast("array<struct<a:int,b:int>>")).alias("line_ranges"))


def line_table(docs: DataFrame) -> DataFrame:
    """Per document the cut lines and the text that stays."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", F.aggregate("line_ranges", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"] + 1).alias("n_cut"),
        F.array_join(F.transform("line_ranges", lambda r: F.concat_ws("-", r["a"], r["b"])), ",").alias("cut"), "text")


#: The same in DuckDB, for distinct ids.
SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)),
full_lines AS (SELECT doc_id, pos, trim(line) AS l FROM lines WHERE trim(line) <> ''),
wide AS (SELECT doc_id, pos AS a, lead(pos, 2) OVER w AS b, l AS l1, lead(l, 1) OVER w AS l2, lead(l, 2) OVER w AS l3
         FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
placed AS (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, a) AS nth FROM wide WHERE b IS NOT NULL),
later AS (SELECT doc_id, a, b FROM placed WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM later),
islands AS (SELECT doc_id, min(pos) AS a, max(pos) AS b, count(*) AS n
            FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM covered) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, sum(n) AS n_cut, string_agg(a || '-' || b, ',' ORDER BY a) AS cut FROM islands GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_cut, 0) AS BIGINT) AS n_cut, coalesce(cut, '') AS cut,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN cuts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
