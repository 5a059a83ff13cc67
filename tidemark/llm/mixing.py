"""Mix sources to target weights by entropy balancing.

Among all document rates r with 0 <= r <= cap whose words add up to the targets,
the one nearest to "every document once" in relative entropy is
r = min(cap, exp(lambda * size / scale)), with one multiplier per source. The
multipliers are the minimum of the convex dual; they are found by Newton steps
inside a bracket. A step reads only the table of (source, size, documents), which
is summed once, and adds decimals, so that the order of rows changes nothing.

Rates become whole copies by a draw per document. The cut of the draw is set per
source from sums over 65,536 bins of it, so that the words taken come within about
one document of the target instead of within a random error.

Defined results: a null text has size 0; a null source is a source of its own, last
in order; documents without words follow their rate of 1; sources without words
have target 0; an empty table gives no rows. Rows equal in doc_id, source and size
(repeated rows, null ids) get draws of their own: in ``mix_table`` evenly spaced ones by
their number, in ``mixed_documents`` by their place in the table where they outweigh a
4,096th of their source, so that no group of equal rows moves as one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attach, attach_salted, fits, numbered, stored, unit, words

WEIGHTS = (5, 2, 1)
CAP = 3
BINS = 65_536
STEPS = 40
TOLERANCE = 1e-3
GRID = (-32.0, -16.0, -8.0, -4.0, -2.0, -1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
BETWEEN = 7
#: Equal rows of more than this share of their source are drawn row by row.
HEAVY = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, n, source_size, target) from (source, size, n).

    Sources are filled at one level per unit of weight; those whose limit of cap
    times their size lies below the level stop there. The windows hold one row
    per source.
    """
    per = sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.partitionBy().orderBy(F.asc_nulls_last("source"))
    dealt = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("_rank", F.row_number().over(order) - 1)
    per = per.withColumn("_w", F.get(dealt, (F.col("_rank") % len(weights)).cast("int")).cast("double"))
    limit = F.col("source_size") * cap
    fill = Window.partitionBy().orderBy("_ratio", "_rank")
    per = per.withColumn("_ratio", limit / F.col("_w"))
    full = F.coalesce(F.sum(limit).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("_level", (total - full) / rest)
    level = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_rank", "_level"))).over(Window.partitionBy())["_level"]
    per = per.withColumn("_at", level)
    return per.select("source", "n", "source_size", F.when(F.col("_at").isNull(), limit.cast("double")).otherwise(
        F.least(limit.cast("double"), F.col("_w") * F.col("_at"))).alias("target"))


def _rate(lam, size, scale, cap: int):
    return F.exp(F.least(lam * size / scale, F.log(F.lit(float(cap)))))


def solve(sizes: DataFrame, targets: DataFrame, cap: int = CAP, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Multipliers of the dual: targets with ``lam`` and ``scale`` (the mean size).

    A first pass over the histogram tries the multipliers of GRID and starts each source at the best;
    every further pass is a Newton step of all sources, held inside a bracket that points tried
    between its ends tighten (the cap puts a kink into the sums where a very long document reaches it).
    Sources at their limit need no multiplier: ``lam`` stays null and the rate is the cap. The
    tolerance is relative to the target; the cut of the draws closes the rest.
    """
    free = (F.col("target") < F.col("source_size") * cap) & (F.col("source_size") > 0)
    scaled = targets.withColumn("scale", F.greatest(F.col("source_size") / F.col("n"), F.lit(1.0)))
    fixed = scaled.where(~free).withColumn("lam", F.lit(None).cast("double"))
    state, small = scaled.where(free), fits(targets)
    keys = ["source", "n", "source_size", "target", "scale"]
    side = sizes.select(F.col("source").alias("_s"), "size", F.col("n").alias("_n"))

    def summed(state: DataFrame, more: list[str], *sums: Column) -> DataFrame:
        both = side.join(F.broadcast(state) if small else state, F.col("source").eqNullSafe(F.col("_s")))
        return both.groupBy(*keys, *more).agg(*sums)

    def words_at(lam: Column) -> Column:
        return F.col("_n") * F.col("size") * _rate(lam, F.col("size"), F.col("scale"), cap)

    def exact(c: Column) -> Column:
        return F.sum(c.cast("decimal(38,9)")).cast("double")  # the order of rows changes nothing

    tried = summed(state, [], *[exact(words_at(F.lit(x))).alias(f"_g{i}") for i, x in enumerate(GRID)])
    found = [(F.lit(x), F.col(f"_g{i}") - F.col("target")) for i, x in enumerate(GRID)]
    best = F.array_min(F.array(*[F.struct(F.abs(over).alias("over"), x.alias("lam")) for x, over in found]))["lam"]
    state = stored(tried.select(
        *keys, best.alias("lam"), F.array_max(F.array(*[F.when(over <= 0, x) for x, over in found])).alias("lo"),
        F.array_min(F.array(*[F.when(over > 0, x) for x, over in found])).alias("hi"), F.lit(1.0).alias("miss")), "mix-state")
    for _ in range(steps):
        lam, size = F.col("lam"), F.col("size")
        low, high = F.coalesce("lo", lam - 16), F.coalesce("hi", lam + 16)
        at = [lam] + [low + (high - low) * i / (BETWEEN + 1) for i in range(1, BETWEEN + 1)]
        curve = F.when(_rate(lam, size, F.col("scale"), cap) < cap, words_at(lam) * size / F.col("scale")).otherwise(0.0)
        sums = summed(state, ["lam", "lo", "hi"], exact(curve).alias("_h"), *[exact(words_at(x)).alias(f"_g{i}") for i, x in enumerate(at)])
        seen = [(x, F.col(f"_g{i}") - F.col("target")) for i, x in enumerate(at)]
        sums = sums.withColumns({
            "_lo": F.array_max(F.array("lo", *[F.when(over <= 0, x) for x, over in seen])),
            "_hi": F.array_min(F.array("hi", *[F.when(over > 0, x) for x, over in seen])),
            "_best": F.array_min(F.array(*[F.struct(F.abs(over).alias("over"), x.alias("lam")) for x, over in seen])),
            "_to": lam - seen[0][1] / F.when(F.col("_h") > 0, F.col("_h"))})
        below, above = F.coalesce("_lo", F.col("_hi") - 16), F.coalesce("_hi", F.col("_lo") + 16)
        to = F.when((F.col("_to") > below) & (F.col("_to") < above), F.col("_to")).otherwise((below + above) / 2)
        miss = F.col("_best.over") / F.greatest(F.col("target"), F.lit(1.0))
        state = stored(sums.select(
            *keys, F.round(F.when(miss > tolerance, to).otherwise(F.col("_best.lam")), 12).alias("lam"),
            F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), miss.alias("miss")), "mix-state")
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return fixed.unionByName(state.select(*keys, "lam"))


def _copies(lam, scale, size, draw, cap: int):
    """(rate, whole part, bin of the draw); a draw adds a copy when its bin is up to the cut of its source."""
    rate = F.round(F.when(lam.isNull(), F.lit(float(cap))).otherwise(_rate(lam, size, scale, cap)), 12)
    place = F.floor((draw - (rate - F.floor(rate)) + 1) / 2 * BINS).cast("int")
    return rate, F.floor(rate).cast("int"), F.when(rate >= cap, F.lit(BINS)).otherwise(place)


def cuts(measured: DataFrame, rates: DataFrame, cap: int = CAP) -> DataFrame:
    """rates with ``cut``: draws in bins up to it add one copy (at most BINS rows per source)."""
    drawn = attach(measured, rates.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    _, whole, place = _copies(F.col("lam"), F.col("scale"), F.col("size"), F.col("_u"), cap)
    bins = drawn.withColumns({"_whole": whole, "_bin": place}).groupBy("_s", "_bin").agg(
        F.sum(F.col("size") * F.col("_whole")).alias("_base"), F.sum("size").alias("_more"), F.max("target").alias("target"))
    run = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    each = Window.partitionBy("_s")
    need = F.col("target") - F.sum("_base").over(each)
    bins = bins.withColumns({"_need": need, "_sum": F.sum("_more").over(run)})
    gap = F.abs(F.col("_sum") - F.col("_need"))
    best = bins.where(F.col("_bin") < BINS).groupBy("_s").agg(
        F.min(F.struct(gap.alias("gap"), F.col("_bin").alias("bin"))).alias("_best"), F.max("_need").alias("_need"))
    cut = best.select("_s", F.when(F.col("_best.gap") < F.abs("_need"), F.col("_best.bin")).otherwise(F.lit(-1)).alias("cut"))
    cut = stored(cut, "mix-cuts")
    return attach(rates, cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("cut", F.coalesce("cut", F.lit(-1)))


def plan(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One stored row per source (source_size, target, lam, scale, cut) from stored rows (source, size, _u)."""
    sizes = stored(measured.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    targets = stored(source_targets(sizes, weights, cap), "mix-targets")
    return stored(cuts(measured, solve(sizes, targets, cap), cap), "mix-plan")


def mix(sized: DataFrame, planned: DataFrame, cap: int = CAP) -> DataFrame:
    """Rows with ``_size`` and ``_u``: the other columns, _size, _source_size, _target, _rate and _copies.

    Nothing is shuffled when the plan is small.
    """
    names = [c for c in sized.columns if c not in ("_size", "_u")]
    side = planned.select(*[F.col(c).alias(f"_p_{c}") for c in planned.columns])
    out = attach(sized, side, F.col("source").eqNullSafe(F.col("_p_source")))
    rate, whole, place = _copies(F.col("_p_lam"), F.col("_p_scale"), F.col("_size"), F.col("_u"), cap)
    copies = whole + F.when(place <= F.col("_p_cut"), 1).otherwise(0)
    return out.select(
        *names, F.col("_size"), F.col("_p_source_size").alias("_source_size"), F.col("_p_target").alias("_target"),
        rate.alias("_rate"), copies.alias("_copies"))


def counted_rows(sized: DataFrame) -> DataFrame:
    """(doc_id, source, size, n) of rows with ``size``: how many are equal in the three columns."""
    return stored(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-equal")


def heavy_rows(counted: DataFrame) -> DataFrame:
    """Keys (by hash) of equal rows that hold more than 1/HEAVY of the words of their source."""
    per = counted.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / HEAVY).alias("_share")).withColumnRenamed("source", "_s")
    repeated = counted.where("n > 1").join(per, F.col("source").eqNullSafe(F.col("_s")))
    return stored(repeated.where(F.col("size") * F.col("n") > F.col("_share")).select(
        F.xxhash64("doc_id", "source", "size").alias("_key"), F.lit(True).alias("_own")).distinct(), "mix-heavy")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The columns of docs, each row as often as the mix takes it.

    Reruns agree when the table is read in the same splits; else only the draws of heavy equal rows move.
    """
    place = F.monotonically_increasing_id()
    narrow = stored(docs.select("doc_id", "source", words("text").alias("size"), place.alias("_place")), "mix-rows")
    heavy = heavy_rows(counted_rows(narrow))

    def drawn(rows: DataFrame, size: str) -> DataFrame:
        keyed = rows.withColumn("_key", F.xxhash64("doc_id", "source", size))
        out = attach_salted(keyed, heavy, ["_key"], F.col("_place"), "left")
        return out.withColumn("_u", F.when(F.col("_own"), unit("doc_id", "_place")).otherwise(unit("doc_id"))).drop("_key", "_own", "_place")

    planned = plan(stored(drawn(narrow, "size").select("source", "size", "_u"), "mix-sizes"), weights, cap)
    sized = docs.withColumns({"_size": words("text"), "_place": place})
    out = mix(drawn(sized, "_size"), planned, cap)
    return out.where("_copies > 0").withColumn("_one", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*docs.columns)


def mix_table(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per document with the words the mix takes; equal rows share out evenly spaced draws."""
    rows = numbered(counted_rows(docs.select("doc_id", "source", words("text").alias("size"))))
    spaced = F.pmod(unit("doc_id") + F.col("ordinal") / F.col("n"), F.lit(1.0))
    rows = stored(rows.select("doc_id", "source", "size", spaced.alias("_u")), "mix-sizes")
    return mix(rows.withColumnRenamed("size", "_size"), plan(rows, weights, cap), cap).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).cast("long").alias("taken"), F.col("_copies").alias("copies"), F.col("_rate").alias("rate"))
