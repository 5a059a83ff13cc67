"""Samples, splits, bootstraps and permutations by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions.hashing import PRIME, poisson_array, row_hash, shuffle_values, shuffled, shuffled_array, uniform
from tidemark.operators.joins import small
from tidemark.operators.ordered import Series, series
from tidemark.operators.quantiles import exact_quantiles

RANGE = float(1 << 32)
PACK = 4096  # rows of a run that is permuted at once
FEW = 1024  # rows of a block, below which blocks are permuted together


def hash_cap(df: DataFrame, keys: list[str], row_id: str, cap: int, seed: int = 42) -> DataFrame:
    """The ``cap`` rows of each key with the smallest hashes.

    Hashes are uniform, so nearly all rows of a large key lie above a bound that
    its size gives; they are dropped where they are read and only about ``cap``
    rows per key are ranked.  A key left with too few rows gets no bound.  Without
    keys the bound is a literal; with keys the table of bounds (one row per key) is
    broadcast when a count allows it.
    """
    hashed = df.withColumn("_h", row_hash(row_id, seed))
    share = lambda n: (cap + 8.0 * (cap ** 0.5) + 40.0) / n
    if not keys:
        n = df.count()
        bound = RANGE if not n or share(n) >= 1.0 else share(n) * RANGE
        if bound < RANGE and hashed.where(F.col("_h") < bound).count() < min(cap, n):
            bound = RANGE
        return hashed.where(F.col("_h") < bound).orderBy("_h", row_id).limit(cap).select(*df.columns)
    part = F.col("_n")
    sizes = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_bound", F.when(share(part) >= 1.0, RANGE).otherwise(share(part) * RANGE))
    kept = hashed.join(small(sizes), keys).groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.max("_bound").alias("_bound"), F.count_if(F.col("_h") < F.col("_bound")).alias("_k"))
    bounds = kept.select(*keys, F.when(
        F.col("_k") < F.least(F.lit(cap), F.col("_n")), RANGE).otherwise(F.col("_bound")).alias("_bound"))
    bounded = hashed.join(small(bounds), keys).where(F.col("_h") < F.col("_bound"))
    w = Window.partitionBy(*keys).orderBy("_h", row_id)
    out = bounded.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
    return out.select(*df.columns)


def stratified_units(
    units: DataFrame, group: str, unit: str, per_group: int, whole: list, seed: int = 42
) -> DataFrame:
    """``per_group`` hashed units of each group, and all units of some groups."""
    w = Window.partitionBy(group).orderBy(row_hash(F.concat_ws("_", F.col(group).cast("string"), F.col(unit)), seed), unit)
    ranked = units.select(group, unit).distinct().withColumn("_r", F.row_number().over(w))
    return ranked.where((F.col("_r") <= per_group) | F.col(group).isin(whole)).drop("_r")


def train_validation(df: DataFrame, row_id: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """A column ``part`` with a fixed split by hash."""
    u = row_hash(row_id, seed) / RANGE
    return df.withColumn("part", F.when(u < share, "validation").otherwise("train"))


def game_folds(df: DataFrame, group: str, unit: str, fold: str = "A") -> DataFrame:
    """Units of each group in order, every other one for calibration."""
    w = Window.partitionBy(group).orderBy(unit)
    turn = 0 if fold == "A" else 1
    return df.select(group, unit).distinct().withColumn(
        "split", F.when((F.row_number().over(w) - 1) % 2 == turn, "calib").otherwise("test"))


def replicate_sums(
    df: DataFrame, keys: list[str], row_id: Column, reps: int, sums: dict[str, Column], first: int = 0
) -> DataFrame:
    """Weighted sums per key and bootstrap replicate: ``n``, how many rows were drawn, and ``sums`` as doubles.

    Rows are read once and never multiplied: every task draws for some rows and all replicates at a time and
    keeps one vector of sums per key. These vectors are what is shuffled; replicates are added up
    afterwards. Rows without an id are never drawn; a value that is null adds nothing.
    """
    names = list(sums)
    rows = df.where(row_id.isNotNull()).select(
        *keys, F.pmod(row_id.cast("bigint"), F.lit(PRIME)).alias("_id"),
        *[F.coalesce(e.cast("double"), F.lit(0.0)).alias(f"_s{k}") for k, e in enumerate(sums.values())])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    lists = ["_n array<bigint>"] + [f"_s{k} array<double>" for k in range(len(names))]
    # a row costs thousands of draws, so the few numbers of it are dealt to all tasks first
    dealt = rows.repartition(session.parallelism(df.sparkSession), "_id")
    parts = dealt.mapInPandas(_replicate_vectors(keys, len(names), reps, first), ", ".join([f"`{k}` {kinds[k]}" for k in keys] + lists))
    zipped = F.posexplode(F.arrays_zip("_n", *[f"_s{k}" for k in range(len(names))])).alias("_at", "_v")
    flat = parts.select(*keys, zipped).select(*keys, (F.col("_at") + first).alias("rep"), "_v.*")
    # few rows beside the draws they cost, and read several times by what follows
    return session.cut(flat.groupBy(*keys, "rep").agg(F.sum("_n").alias("n"), *[F.sum(f"_s{k}").alias(n) for k, n in enumerate(names)]))


DRAWS, VECTORS = 1 << 16, 4 << 20  # draws made at once, so that they stay in the cache; numbers kept before vectors are sent on


def _replicate_vectors(keys: list[str], width: int, reps: int, first: int):
    columns = [f"_s{k}" for k in range(width)]

    def rows_of(kept: dict) -> pd.DataFrame:
        out = pd.DataFrame([k for k, _, _ in kept.values()], columns=keys) if keys else pd.DataFrame(index=range(len(kept)))
        out["_n"] = [n for _, n, _ in kept.values()]
        for c in range(width):
            out[columns[c]] = [s[c] for _, _, s in kept.values()]
        return out

    def vectors(frames):
        kept: dict = {}
        rep = np.arange(first, first + reps, dtype=np.int64)
        for pdf in frames:
            for _, part in pdf.groupby(keys, sort=False, dropna=False) if keys else [(None, pdf)]:
                key = [part[k].iloc[0] for k in keys]
                _, n, s = kept.setdefault(str(key), (key, np.zeros(reps, np.int64), np.zeros((width, reps))))
                ids, values = part["_id"].to_numpy(np.int64), part[columns].to_numpy(float)
                counted = np.column_stack([np.ones(len(ids)), values]).T
                step = max(1, DRAWS // max(reps, 1))
                for at in range(0, len(ids), step):
                    sums = counted[:, at:at + step] @ poisson_array(ids[at:at + step], rep)
                    n += sums[0].astype(np.int64)
                    s += sums[1:]
                if len(kept) * reps * (1 + width) > VECTORS:
                    yield rows_of(kept)
                    kept.clear()
        if kept:
            yield rows_of(kept)

    return vectors


def interval(reps: DataFrame, keys: list[str], stat: str, level: float = 0.95) -> DataFrame:
    """Percentile interval over replicates."""
    tail = (1.0 - level) / 2
    q = exact_quantiles(reps.where(F.col(stat).isNotNull()), keys, stat, [tail, 1.0 - tail], "_q")
    return q.select(*keys, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, row_id: str, reps: int = 2000) -> DataFrame:
    """Mean with a bootstrap interval per key."""
    sums = replicate_sums(df, keys, F.col(row_id), reps, {"s": F.col(value)})
    ci = interval(sums.withColumn("m", F.try_divide("s", "n")), keys, "m")
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).join(ci, keys)


def bootstrap_weighted(
    target: DataFrame, base_sums: DataFrame, keys: list[str], value: str, weight: str, row_id: str,
    reps: int = 2000,
) -> DataFrame:
    """Per key and replicate: plain mean, weighted mean and recovered share.

    ``base_sums`` holds (rep, base_mean), drawn once for the baseline.
    """
    sums = replicate_sums(target, keys, F.col(row_id), reps, {
        "sx": F.col(value), "sw": F.col(weight), "swx": F.col(weight) * F.col(value)})
    out = sums.join(F.broadcast(base_sums), "rep")
    mean, iw = F.try_divide("sx", "n"), F.try_divide("swx", "sw")
    excess = mean - F.col("base_mean")
    return out.select(
        *keys, "rep", mean.alias("mean"), iw.alias("iw"), (mean - iw).alias("correction"),
        F.when(excess > 1e-6, (mean - iw) / excess * 100).alias("recovery"))


def block_sums(df: DataFrame, keys: list[str], block: str, value: str, weight: str | None = None) -> DataFrame:
    """Sufficient sums per block, so that replicates never touch rows again."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(value).alias("sx")]
    if weight:
        aggs += [F.sum(weight).alias("sw"), F.sum(F.col(weight) * F.col(value)).alias("swx")]
    return df.groupBy(*keys, block).agg(*aggs)


def block_draws(blocks: DataFrame, keys: list[str], block: str, reps: int, sums: list[str]) -> DataFrame:
    """Replicates that draw as many blocks as there are, with replacement.

    Draw d of replicate r takes the block whose rank is floor(u * blocks).  The
    draws meet blocks by rank, so the work is replicates times blocks.
    """
    w = Window.partitionBy(*keys).orderBy(block)
    whole = Window.partitionBy(*keys)
    ranked = blocks.withColumn("_rank", F.row_number().over(w) - 1).withColumn(
        "_m", F.count(F.lit(1)).over(whole))
    draws = ranked.select(*keys, F.col("_rank").alias("_d"), "_m").withColumn(
        "rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    pick = F.floor(uniform(F.col("_d") + 1, F.col("rep")) * F.col("_m")).cast("int")
    draws = draws.select(*keys, "rep", pick.alias("_rank"))
    return draws.join(ranked.drop("_m"), [*keys, "_rank"]).groupBy(*keys, "rep").agg(
        *[F.sum(s).alias(s) for s in sums])


def line_replicates(df: DataFrame, keys: list[str], x: str, y: str, row_id: str, reps: int) -> DataFrame:
    """Slope and intercept per replicate from five sums; flat replicates dropped."""
    s = replicate_sums(df, keys, F.col(row_id), reps, {
        "sx": F.col(x), "sy": F.col(y), "sxy": F.col(x) * F.col(y), "sxx": F.col(x) * F.col(x)})
    s = s.where("n > 0")
    n = F.col("n")
    vx = F.col("sxx") / n - (F.col("sx") / n) * (F.col("sx") / n)
    slope = (F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n) / vx
    return s.where(vx >= 1e-24).select(
        *keys, "rep", slope.alias("slope"),
        (F.col("sy") / n - slope * F.col("sx") / n).alias("intercept"))


def line_band(fits: DataFrame, keys: list[str], grid: DataFrame) -> DataFrame:
    """Mean and interval of the replicate lines at each grid point."""
    points = grid.groupBy(*keys).agg(F.collect_list("x").alias("_grid"))
    at = fits.join(points, keys) if keys else fits.withColumn("_grid", points.scalar())
    at = at.withColumn("x", F.explode("_grid")).drop("_grid").withColumn("pred", F.col("slope") * F.col("x") + F.col("intercept"))
    mean = at.groupBy(*keys, "x").agg(F.avg("pred").alias("mean"))
    return mean.join(interval(at, [*keys, "x"], "pred"), [*keys, "x"])


def _blocks(s: Series, block: str) -> tuple[Series, DataFrame]:
    """Rows with their place in their block, and the blocks with size, rank and first position, by their first row."""
    keys, idx = s.keys, s.idx
    inner = series(s.df, [*keys, block], [idx], "_offset")
    found = inner.df.groupBy(*keys, block).agg(F.min(idx).alias("_first"), F.count(F.lit(1)).alias("_m"))
    order = Window.partitionBy(*keys).orderBy("_first")
    whole = Window.partitionBy(*keys)
    blocks = found.select(*keys, F.col(block), "_m", (F.row_number().over(order) - 1).cast("long").alias("_rank"),
                          F.count(F.lit(1)).over(whole).alias("_n"),
                          F.coalesce(F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return inner, blocks


def _begins(blocks: DataFrame, keys: list[str], block: str, reps: int) -> DataFrame:
    """First position of every block in each replicate."""
    replicates = F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    moved = shuffled(blocks.withColumn("_zero", F.lit(0).cast("long")).select("*", replicates), "_rank", "_n", "_zero", "rep", "_turn")
    turn = Window.partitionBy(*keys, "rep").orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    begins = moved.select(*keys, block, "rep", F.coalesce(F.sum("_m").over(turn), F.lit(0)).alias("_begin"))
    return begins.groupBy(*keys, block).agg(F.collect_list(F.struct("rep", "_begin")).alias("_reps"))  # reps entries each


def permuted(s: Series, scheme: str, block: str, reps: int) -> Series:
    """Every series in ``reps`` permuted orders: the keys and ``rep`` are the new keys.

    Positions come from a bijection, so nothing is sorted but the blocks, which are few beside their rows.
    ``full`` permutes all rows, ``within`` the rows of each block, ``blocks`` whole blocks, which keep their inner order.
    A block's rows stand together afterwards, blocks by their first row.
    """
    keys, idx = s.keys, s.idx
    replicates = F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    if scheme == "full":
        sizes = s.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        rows = s.df.join(small(sizes), keys).withColumn("_start", F.lit(0).cast("long")).select("*", replicates)
        out = shuffled(rows, idx, "_n", "_start", "rep", "_new").drop("_n", "_start")
    elif scheme in ("within", "blocks"):
        inner, blocks = _blocks(s, block)
        if scheme == "within":
            rows = inner.df.join(small(blocks), [*keys, block]).select("*", replicates)
            out = shuffled(rows, "_offset", "_m", "_start", "rep", "_new").withColumn("_new", F.col("_new") + F.col("_start"))
        else:
            lists = _begins(blocks, keys, block, reps)
            out = inner.df.join(small(lists), [*keys, block]).select("*", F.inline("_reps")).withColumn("_new", F.col("_begin") + F.col("_offset"))
        out = out.drop("_offset", "_m", "_rank", "_n", "_start", "_begin", "_reps")
    else:
        raise ValueError(f"unknown scheme {scheme}")
    return Series(out.drop(idx).withColumnRenamed("_new", idx), [*keys, "rep"], idx, s.count * reps, s.longest)


def packed_permutations(s: Series, value: str, scheme: str, block: str, reps: int, size: int) -> DataFrame:
    """The orders of ``permuted`` without a row for every row and replicate: runs of rows are packed first.

    One row per run, replicate and chunk of ``size`` new positions that it reaches: the keys, ``rep``, ``chunk``, the
    positions in the chunk (``at``, 32-bit) and the values there (``x``, doubles, null as NaN).
    """
    keys, idx = list(s.keys), s.idx
    if scheme == "full":
        packs = _packed(s.df.withColumn("_place", F.col(idx)), keys, value)
        sizes = s.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        packs = packs.join(small(sizes), keys).withColumn("_start", F.lit(0).cast("long"))
    elif scheme in ("within", "blocks"):
        inner, blocks = _blocks(s, block)
        packs = _packed(inner.df.withColumn("_place", F.col("_offset")), [*keys, block], value)
        if scheme == "within":
            packs = packs.join(small(blocks.withColumnRenamed("_m", "_size")), [*keys, block]).withColumn("_n", F.col("_size"))
        else:
            packs = packs.join(small(_begins(blocks, keys, block, reps)), [*keys, block])
    else:
        raise ValueError(f"unknown scheme {scheme}")
    names = {f.name: f.dataType.simpleString() for f in s.df.schema.fields}
    moved = scheme == "blocks"
    extra = [F.transform("_reps", lambda r: r["rep"]).alias("_rep"), F.transform("_reps", lambda r: r["_begin"]).alias("_begin")] if moved else ["_n", "_start"]

    def places(place: np.ndarray, row: dict) -> Iterator[tuple[int, np.ndarray]]:
        if moved:
            yield from ((r, place + b) for r, b in zip(row["_rep"], row["_begin"]))
        else:
            n, start = np.int64(row["_n"]), np.int64(row["_start"])
            yield from ((r, shuffled_array(place, n, start, np.int64(r)) + start) for r in range(reps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c not in ("_places", "_values")}
                place = batch.column("_places")[i].values.to_numpy()
                x = batch.column("_values")[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
                out = []
                for rep, new in places(place, row):
                    chunk, at = np.divmod(new, size)
                    first, last = int(chunk.min()), int(chunk.max())
                    for c in range(first, last + 1):
                        own = slice(None) if first == last else chunk == c
                        if len(at[own]):
                            out.append((rep, c, at[own].astype(np.int32).tobytes(), x[own].tobytes()))
                columns = [pa.array([row[k]] * len(out), batch.schema.field(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary())))],
                    [*keys, "rep", "chunk", "at", "x"])

    spread = packs.select(*keys, "_places", "_values", *extra).repartition(session.parallelism(s.spark))
    return spread.mapInArrow(run, ", ".join(f"`{k}` {names[k]}" for k in keys) + ", rep int, chunk bigint, at binary, x binary")


def packed_series(s: Series, value: str, scheme: str, block: str) -> DataFrame:
    """Every series in runs of at most PACK rows, in the order that ``permuted_array`` starts from: the keys, the first
    position ``_from`` and ``_values`` (doubles). Blocks are rows too, with ``_from``, size ``_m`` and ``_rank``, without values.
    """
    keys = list(s.keys)
    if scheme == "full":
        return _runs(s.df.withColumn("_place", F.col(s.idx)).withColumn("_start", F.lit(0).cast("long")), [*keys, "_start"], keys, value)
    if scheme not in ("within", "blocks"):
        raise ValueError(f"unknown scheme {scheme}")
    inner, blocks = _blocks(s, block)
    blocks = session.cut(blocks)
    rows = inner.df.join(small(blocks.select(*keys, block, "_start")), [*keys, block]).withColumn("_place", F.col("_offset"))
    own = blocks.select(*keys, F.col("_start").alias("_from"), "_m", "_rank", F.lit(None).cast("array<double>").alias("_values"))
    return _runs(rows, [*keys, block, "_start"], keys, value).unionByName(own)


def _runs(df: DataFrame, group: list[str], keys: list[str], value: str) -> DataFrame:
    run = F.floor(F.col("_place") / PACK)
    rows = F.array_sort(F.collect_list(F.struct("_place", F.col(value).cast("double").alias("x"))))
    runs = df.groupBy(*group, run.alias("_run")).agg(rows.alias("_rows"))
    nothing = F.lit(None).cast("long")
    return runs.select(*keys, (F.col("_start") + F.col("_run") * PACK).cast("long").alias("_from"), nothing.alias("_m"), nothing.alias("_rank"),
                       F.transform("_rows", lambda r: r["x"]).alias("_values"))


def permuted_array(x: np.ndarray, blocks: np.ndarray, scheme: str, rep: int) -> np.ndarray:
    """The values of a series in the order of ``permuted``, from the rows of ``packed_series``; blocks are (start, size, rank)."""
    if scheme == "blocks":
        turn = shuffled_array(blocks[:, 2], np.int64(len(blocks)), np.int64(0), np.int64(rep))
        return np.concatenate([x[:0], *(x[a:a + m] for a, m in blocks[np.argsort(turn), :2].tolist())])
    out = x.copy()
    if scheme == "full":
        shuffle_values(out, 0, rep)
        return out
    for a, m in blocks[blocks[:, 1] >= FEW, :2].tolist():
        shuffle_values(out[a:a + m], a, rep)
    few = blocks[blocks[:, 1] < FEW]
    ends = np.cumsum(few[:, 1])
    start, size = np.repeat(few[:, 0], few[:, 1]), np.repeat(few[:, 1], few[:, 1])
    place = np.arange(len(start)) - np.repeat(ends - few[:, 1], few[:, 1])
    out[start + shuffled_array(place, size, start, np.int64(rep))] = x[start + place]
    return out


def _packed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of at most PACK neighbouring places of each key as two arrays."""
    run = df.groupBy(*keys, F.floor(F.col("_place") / PACK).alias("_run")).agg(F.collect_list(F.struct("_place", F.col(value).cast("double").alias("x"))).alias("_rows"))
    return run.select(*keys, F.transform("_rows", lambda r: r["_place"]).alias("_places"), F.transform("_rows", lambda r: r["x"]).alias("_values"))


def weighted_draws(df: DataFrame, weight: str, order: str, draws: int, rep: int = 0) -> DataFrame:
    """``draws`` rows with replacement, with chances in proportion to the weight.

    Row i owns the stretch (before, before + w] of the total weight.  A uniform
    draw picks the owner of its stretch.  Draws are spread by stretches of equal
    width, and a row meets only the stretches it overlaps.
    """
    from tidemark.operators.ordered import running

    spark = df.sparkSession
    cum = running(df, [], [order], {"_below": F.col(weight)}, {"_total": "_below"})
    cells = max(1, draws)
    low = F.col("_below") / F.col("_total")
    high = (F.col("_below") + F.col(weight)) / F.col("_total")
    spans = cum.where(F.col(weight) > 0).withColumn("_lo", low).withColumn("_hi", high).withColumn(
        "_cell", F.explode(F.sequence(
            F.floor(F.col("_lo") * cells).cast("long"),
            F.least(F.floor(F.col("_hi") * cells), F.lit(cells - 1)).cast("long"))))
    picks = spark.range(1, draws + 1).select(
        F.col("id").alias("draw"), uniform(F.col("id"), F.lit(rep)).alias("_u"))
    picks = picks.withColumn("_cell", F.floor(F.col("_u") * cells).cast("long"))
    hit = spans.join(picks, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return hit.select(*df.columns, "draw")


def baseline_size_sweep(
    games: DataFrame, base_year: int, most: int, reps: int, unit: str = "proc_set_file"
) -> DataFrame:
    """Baseline mean and excess when only n of the baseline games are used.

    ``games`` holds (unit, year, n, sx).  For each n and replicate the n games
    with the smallest draws are taken, without replacement.
    """
    base = games.where(F.col("year") == base_year)
    gid = row_hash(unit)
    drawn = (
        base.withColumn("n_games", F.explode(F.sequence(F.lit(1), F.lit(most))))
        .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        .withColumn("_u", uniform(gid, F.col("rep") * 31 + F.col("n_games")))
    )
    w = Window.partitionBy("n_games", "rep").orderBy("_u", unit)
    chosen = drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("n_games"))
    base_mean = chosen.groupBy("n_games", "rep").agg((F.sum("sx") / F.sum("n")).alias("ade_base"))
    target = games.where(F.col("year") != base_year).groupBy("year").agg(
        (F.sum("sx") / F.sum("n")).alias("ade_y"))
    years = target.agg(F.collect_list(F.struct("year", "ade_y"))).scalar()
    return base_mean.select("*", F.inline(years)).select(
        "n_games", "rep", "year", "ade_base", "ade_y", (F.col("ade_y") - F.col("ade_base")).alias("excess"))


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """Median, quartiles and spread of the excess per baseline size and year."""
    q = exact_quantiles(sweep, ["n_games", "year"], "excess", [0.25, 0.5, 0.75])
    sd = sweep.groupBy("n_games", "year").agg(F.stddev_pop("excess").alias("std"))
    return q.join(sd, ["n_games", "year"]).select(
        "n_games", "year", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"),
        F.col("q")[2].alias("q75"), "std")


def first_stable(summary: DataFrame, limit: float = 0.10) -> DataFrame:
    """Smallest baseline size whose spread is below the limit, per year."""
    return summary.groupBy("year").agg(
        F.min(F.when(F.col("std") < limit, F.col("n_games"))).alias("n_stable"))


