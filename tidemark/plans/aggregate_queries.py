"""Queries over grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.operators import aggregates as G
from tidemark.operators import joins as J
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.catalog import query, with_tables
from tidemark.sources import adapters as A

BY = ["model", "year"]


@query("agg01_group_stats", with_tables(A.ERRORS, body="""
SELECT model, year, count(ade_traj) AS n, round(avg(ade_traj), 6) AS mean, round(min(ade_traj), 6) AS low,
       round(max(ade_traj), 6) AS high, round(stddev_pop(ade_traj), 6) AS sd_pop, round(stddev_samp(ade_traj), 6) AS sd_samp
FROM errors GROUP BY model, year"""))
def group_stats(spark, sf):
    out = G.summary_stats(A.errors(spark, sf), BY, "ade_traj")
    return G.rounded(out, "mean", "low", "high", "sd_pop", "sd_samp")


TAILS = """tails AS (
  SELECT model, year, count(*) AS n, avg(ade_traj) AS mean, quantile_cont(ade_traj, 0.5) AS p50,
         quantile_cont(ade_traj, 0.9) AS p90, quantile_cont(ade_traj, 0.99) AS p99
  FROM errors GROUP BY model, year)"""


@query("agg02_tail_quantiles", with_tables(A.ERRORS, TAILS, body="""
SELECT model, year, n, round(mean, 6) AS mean, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p99, 6) AS p99
FROM tails"""))
def tail_quantiles(spark, sf):
    return G.rounded(G.tail_table(A.errors(spark, sf), BY, "ade_traj").drop("tail_ratio"), "mean", "p50", "p90", "p99")


@query("agg03_tail_ratio_change", with_tables(A.ERRORS, TAILS, body=f"""
SELECT t.model, t.year, t.n, round(t.p99 / t.p50, 6) AS tail_ratio,
       round((t.mean - b.mean) / b.mean * 100, 6) AS mean_change_pct,
       round((t.p99 - b.p99) / b.p99 * 100, 6) AS p99_change_pct
FROM tails t JOIN tails b ON t.model = b.model AND b.year = {A.BASE_YEAR}"""))
def tail_ratio_change(spark, sf):
    t = G.tail_table(A.errors(spark, sf), BY, "ade_traj")
    t = G.against_baseline(t, ["model"], "year", A.BASE_YEAR, "mean", "mean_change_pct")
    t = G.against_baseline(t, ["model"], "year", A.BASE_YEAR, "p99", "p99_change_pct")
    return G.rounded(t.select("model", "year", "n", "tail_ratio", "mean_change_pct", "p99_change_pct"),
                     "tail_ratio", "mean_change_pct", "p99_change_pct")


@query("agg04_feature_block", with_tables(A.LINES, body="""
SELECT model, year, round(avg(value), 6) AS v_mean, round(quantile_cont(value, 0.5), 6) AS v_p50,
       round(quantile_cont(value, 0.9), 6) AS v_p90, round(quantile_cont(value, 0.95), 6) AS v_p95,
       round(quantile_cont(value, 0.99), 6) AS v_p99, round(max(value), 6) AS v_max,
       round(avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END), 6) AS v_share_above
FROM lines GROUP BY model, year"""))
def feature_block(spark, sf):
    out = G.feature_block(A.lines(spark, sf), BY, "value", "v", above=5.0)
    return G.rounded(out, *[c for c in out.columns if c.startswith("v_")])


@query("agg05_distinct_units", with_tables(A.ERRORS, body="""
SELECT year, count(DISTINCT proc_set_file) AS n_games, count(DISTINCT model) AS n_models,
       count(DISTINCT traj_id) AS n_traj FROM errors GROUP BY year"""))
def distinct_units(spark, sf):
    return A.errors(spark, sf).groupBy("year").agg(
        F.countDistinct("proc_set_file").alias("n_games"), F.countDistinct("model").alias("n_models"),
        F.countDistinct("traj_id").alias("n_traj"))


@query("agg06_group_sizes", with_tables(A.ERRORS, body="""
SELECT year, proc_set_file, model, count(*) AS n FROM errors GROUP BY year, proc_set_file, model"""))
def group_sizes(spark, sf):
    return G.frame_counts(A.errors(spark, sf), ["year", "proc_set_file", "model"])


@query("agg07_first_context", with_tables(A.ERRORS, body="""
SELECT proc_set_file, year, arg_min(log_file, traj_id) AS log_file, arg_min(model, traj_id) AS model,
       min(traj_id) AS traj_id FROM errors GROUP BY proc_set_file, year"""))
def first_context(spark, sf):
    return G.first_by(A.errors(spark, sf), ["proc_set_file", "year"], ["traj_id"], ["log_file", "model", "traj_id"])


@query("agg08_robust_baseline", with_tables(A.ERRORS, f"""
counts AS (SELECT model, count(*) FILTER (year = {A.BASE_YEAR}) AS n_base FROM errors GROUP BY model),
chosen AS (SELECT e.model, n_base, ade_traj FROM errors e JOIN counts USING (model)
           WHERE year = {A.BASE_YEAR} OR n_base < 460),
med AS (SELECT model, n_base, quantile_cont(ade_traj, 0.5) AS med, stddev_samp(ade_traj) AS sd FROM chosen GROUP BY ALL),
mad AS (SELECT model, quantile_cont(abs(ade_traj - med), 0.5) AS mad FROM chosen JOIN med USING (model) GROUP BY model)""",
    body="""SELECT model, med.n_base, round(med, 6) AS med,
       round(CASE WHEN mad < 1e-9 THEN sd ELSE mad END, 6) AS mad FROM med JOIN mad USING (model)"""))
def robust_baseline(spark, sf):
    out = G.robust_baseline(A.errors(spark, sf), ["model"], "ade_traj", F.col("year") == A.BASE_YEAR, least=460)
    return G.rounded(out, "med", "mad")


def game_context(spark, sf):
    """Counts, duration and feature blocks of each game."""
    s = A.steps(spark, sf).withColumn("speed", F.hypot("vx", "vy")).withColumn("turn", F.abs(F.atan2("vy", "vx")))
    counts = s.groupBy("game").agg(
        F.countDistinct("robot_id").alias("n_trajectories"), F.countDistinct("team").alias("n_unique_stop_ids"),
        (F.count(F.lit(1)) / 60.0).alias("duration_estimate_s"))
    counts = counts.withColumn(
        "avg_robots_per_stoppage", F.col("n_trajectories") / F.greatest(F.lit(1), F.col("n_unique_stop_ids")))
    speed = G.feature_block(s, ["game"], "speed", "speed").drop("speed_p95")
    turn = G.feature_block(s, ["game"], "turn", "turn").select("game", "turn_mean", "turn_p50", "turn_p90")
    return counts.join(speed, "game").join(turn, "game")


@query("agg09_game_context", with_tables(A.DETECTIONS, A.STEPS, """
f AS (SELECT game, robot_id, team, sqrt(vx * vx + vy * vy) AS speed, abs(atan2(vy, vx)) AS turn FROM steps)""", body="""
SELECT game, count(DISTINCT robot_id) AS n_trajectories, count(DISTINCT team) AS n_unique_stop_ids,
       round(count(*) / 60.0, 6) AS duration_estimate_s,
       round(count(DISTINCT robot_id) / greatest(1, count(DISTINCT team)), 6) AS avg_robots_per_stoppage,
       round(avg(speed), 6) AS speed_mean, round(max(speed), 6) AS speed_max,
       round(quantile_cont(speed, 0.5), 6) AS speed_p50, round(quantile_cont(speed, 0.9), 6) AS speed_p90,
       round(quantile_cont(speed, 0.99), 6) AS speed_p99, round(avg(turn), 6) AS turn_mean,
       round(quantile_cont(turn, 0.5), 6) AS turn_p50, round(quantile_cont(turn, 0.9), 6) AS turn_p90
FROM f GROUP BY game"""))
def game_context_query(spark, sf):
    out = game_context(spark, sf)
    return G.rounded(out, *[c for c in out.columns if c not in ("game", "n_trajectories", "n_unique_stop_ids")])


@query("agg10_alarm_counts", with_tables(A.ERRORS, A.STREAM, A.ALARMS, f"""
rows_of AS (SELECT model, count(*) FILTER (year = {A.BASE_YEAR}) AS base_rows,
            count(*) FILTER (year > {A.BASE_YEAR}) AS post_rows FROM errors GROUP BY model)""", body=f"""
SELECT a.model, base_rows, post_rows, count(*) AS n_alarms,
       count(*) FILTER (year = {A.BASE_YEAR}) AS n_base, count(*) FILTER (year > {A.BASE_YEAR}) AS n_post,
       round(1000.0 * count(*) FILTER (year = {A.BASE_YEAR}) / greatest(1, base_rows), 6) AS far_per_1k,
       {", ".join(f"count(*) FILTER (year = {y}) AS n_{y}" for y in A.POST_YEARS)}
FROM alarms a JOIN rows_of USING (model) GROUP BY a.model, base_rows, post_rows"""))
def alarm_counts(spark, sf):
    rows = A.totals(A.errors(spark, sf), ["model"])
    n = lambda y: F.count_if(F.col("year") == y)
    a = A.alarms(spark, sf).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_alarms"), n(A.BASE_YEAR).alias("n_base"),
        F.count_if(F.col("year") > A.BASE_YEAR).alias("n_post"), *[n(y).alias(f"n_{y}") for y in A.POST_YEARS])
    out = a.join(J.small(rows), "model").withColumn("far_per_1k", metrics.far_per_1k(F.col("n_base"), F.col("base_rows")))
    return G.rounded(out, "far_per_1k")


@query("agg11_pivot_models", with_tables(A.ERRORS, body="""
SELECT year, round(avg(ade_traj) FILTER (model = '1-URGENT'), 6) AS urgent,
       round(avg(ade_traj) FILTER (model = '5-LOW'), 6) AS low FROM errors GROUP BY year"""))
def pivot_models(spark, sf):
    out = A.errors(spark, sf).groupBy("year").pivot("model", ["1-URGENT", "5-LOW"]).agg(F.avg("ade_traj"))
    return out.select("year", F.round("1-URGENT", 6).alias("urgent"), F.round("5-LOW", 6).alias("low"))


@query("agg12_unpivot_counts", with_tables(A.ERRORS, body=f"""
SELECT model, 'n_' || year AS measure, count(*) AS n FROM errors
WHERE year IN ({", ".join(str(y) for y in A.POST_YEARS)}) GROUP BY model, year"""))
def unpivot_counts(spark, sf):
    wide = A.errors(spark, sf).groupBy("model").agg(*[
        F.count_if(F.col("year") == y).alias(f"n_{y}") for y in A.POST_YEARS])
    return wide.unpivot("model", [f"n_{y}" for y in A.POST_YEARS], "measure", "n").where("n > 0")


GAME_DIV = """game_div AS (SELECT proc_set_file, year, ade_mean, n_traj, coalesce(division, 'Unknown') AS division
  FROM games LEFT JOIN divisions USING (proc_set_file))"""


def game_divisions(spark, sf):
    return J.lookup(A.games(spark, sf), A.divisions(spark, sf), ["proc_set_file"], "division", "Unknown")


@query("agg13_before_after", with_tables(A.ERRORS, A.GAMES, A.DIVISIONS, GAME_DIV, body="""
SELECT division, round(avg(ade_mean) FILTER (year < 1998), 6) AS before_mean,
       round(avg(ade_mean) FILTER (year >= 1998), 6) AS after_mean,
       round(avg(ade_mean) FILTER (year >= 1998) - avg(ade_mean) FILTER (year < 1998), 6) AS delta
FROM game_div GROUP BY division"""))
def before_after(spark, sf):
    out = game_divisions(spark, sf).groupBy("division").agg(
        F.avg(F.when(F.col("year") < 1998, F.col("ade_mean"))).alias("before_mean"),
        F.avg(F.when(F.col("year") >= 1998, F.col("ade_mean"))).alias("after_mean"))
    return G.rounded(out.withColumn("delta", F.col("after_mean") - F.col("before_mean")),
                     "before_mean", "after_mean", "delta")


@query("agg14_excess_by_group", with_tables(A.ERRORS, A.GAMES, A.DIVISIONS, GAME_DIV, """
m AS (SELECT division, year, avg(ade_mean) AS ade, count(*) AS n_games FROM game_div GROUP BY ALL)""", body=f"""
SELECT m.division, m.year, round(b.ade, 6) AS ade_base, round(m.ade, 6) AS ade_y,
       round(m.ade - b.ade, 6) AS excess, m.n_games
FROM m LEFT JOIN m b ON b.division = m.division AND b.year = {A.BASE_YEAR} WHERE m.year > {A.BASE_YEAR}"""))
def excess_by_group(spark, sf):
    m = game_divisions(spark, sf).groupBy("division", "year").agg(
        F.avg("ade_mean").alias("ade_y"), F.count(F.lit(1)).alias("n_games"))
    base = m.where(F.col("year") == A.BASE_YEAR).select("division", F.col("ade_y").alias("ade_base"))
    out = m.where(F.col("year") > A.BASE_YEAR).join(base, "division", "left")
    return G.rounded(out.withColumn("excess", F.col("ade_y") - F.col("ade_base")), "ade_base", "ade_y", "excess")


@query("agg15_matched_decomposition", with_tables(A.ERRORS, A.GAMES, f"""
pairs AS (SELECT y.year, y.ade_mean AS ade_y, b.ade_mean AS ade_base FROM games y JOIN games b
          ON y.year <> {A.BASE_YEAR} AND b.year = {A.BASE_YEAR} AND abs(y.n_traj - b.n_traj) / b.n_traj <= 0.2),
p AS (SELECT year, count(*) AS n_pairs, avg(ade_y) - avg(ade_base) AS concept FROM pairs GROUP BY year),
t AS (SELECT year, avg(ade_mean) AS ade FROM games GROUP BY year)""", body=f"""
SELECT t.year, coalesce(n_pairs, 0) AS n_pairs, round(t.ade - b.ade, 6) AS excess_total,
       round(concept, 6) AS excess_concept, round(t.ade - b.ade - concept, 6) AS excess_covariate,
       round(CASE WHEN abs(t.ade - b.ade) > 1e-9 THEN concept / (t.ade - b.ade) * 100 END, 4) AS pct_concept
FROM t JOIN t b ON b.year = {A.BASE_YEAR} LEFT JOIN p ON p.year = t.year WHERE t.year <> {A.BASE_YEAR}"""))
def matched_decomposition(spark, sf):
    """Excess split by comparable baseline games, without forming the pairs."""
    games = A.games(spark, sf)
    base = games.where(F.col("year") == A.BASE_YEAR)
    other = games.where(F.col("year") != A.BASE_YEAR)
    met = J.band_aggregate(other, base, "n_traj", "n_traj", "ade_mean", 0.20)
    per_year = met.groupBy("year").agg(
        F.sum("n_pairs").alias("n_pairs"),
        (F.try_divide(F.sum(F.col("ade_mean") * F.col("n_pairs")), F.sum("n_pairs"))
         - F.try_divide(F.sum("partner_sum"), F.sum("n_pairs"))).alias("excess_concept"),
        F.avg("ade_mean").alias("ade"))
    total = F.col("ade") - base.agg(F.avg("ade_mean")).scalar()
    out = per_year.withColumn("excess_total", total).withColumn(
        "excess_covariate", F.col("excess_total") - F.col("excess_concept")).withColumn(
        "pct_concept", F.round(F.when(F.abs("excess_total") > 1e-9, F.col("excess_concept") / F.col("excess_total") * 100), 4))
    return G.rounded(out.drop("ade"), "excess_total", "excess_concept", "excess_covariate")


@query("agg16_block_majority", with_tables(A.ERRORS, A.STREAM, """
n AS (SELECT model, idx // 25 AS block, year, count(*) AS c FROM stream GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model, block ORDER BY c DESC, year) AS k FROM n)""", body="""
SELECT model, block, year AS majority FROM r WHERE k = 1"""))
def block_majority(spark, sf):
    s = A.stream(spark, sf)
    return G.mode_smallest(s.df.withColumn("block", F.floor(F.col("idx") / 25)), ["model", "block"], "year", "majority")


BLOCKS = """b AS (SELECT model, idx // 25 AS block, idx, year, ade_traj,
  row_number() OVER (PARTITION BY model, idx // 25 ORDER BY ade_traj, idx) AS r,
  count(*) OVER (PARTITION BY model, idx // 25) AS n FROM stream)"""


@query("agg17_trimmed_blocks", with_tables(A.ERRORS, A.STREAM, BLOCKS, body="""
SELECT model, block, CAST(mode_year AS INTEGER) AS year, centre, block_mean FROM (
  SELECT model, block, max(idx) FILTER (idx % 25 = 12) AS centre,
         round(avg(ade_traj) FILTER (r > 2 AND r <= 23), 6) AS block_mean, count(*) AS n,
         (SELECT year FROM stream s WHERE s.model = b.model AND s.idx // 25 = b.block
          GROUP BY year ORDER BY count(*) DESC, year LIMIT 1) AS mode_year
  FROM b GROUP BY model, block) WHERE n = 25"""))
def trimmed_blocks(spark, sf):
    return G.rounded(G.blocks(A.stream(spark, sf), "ade_traj", 25, trim=0.10), "block_mean")


@query("agg18_blocks", with_tables(A.ERRORS, A.STREAM, body="""
SELECT model, block, year, centre, block_mean FROM (
  SELECT model, idx // 40 AS block, count(*) AS n, round(avg(ade_traj), 6) AS block_mean,
         max(idx) FILTER (idx % 40 = 20) AS centre
  FROM stream GROUP BY model, idx // 40) g
JOIN (SELECT model AS m2, block AS b2, year FROM (
  SELECT model, idx // 40 AS block, year, row_number() OVER (
    PARTITION BY model, idx // 40 ORDER BY count(*) DESC, year) AS k
  FROM stream GROUP BY model, idx // 40, year) WHERE k = 1) y ON y.m2 = g.model AND y.b2 = g.block
WHERE n = 40"""))
def plain_blocks(spark, sf):
    return G.rounded(G.blocks(A.stream(spark, sf), "ade_traj", 40), "block_mean")


@query("agg19_histogram", with_tables(A.LINES, """
edges AS (SELECT quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM lines),
binned AS (SELECT model, CAST(least(floor((value - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, lo, hi
           FROM lines, edges WHERE value BETWEEN lo AND hi),
tot AS (SELECT model, count(*) AS t FROM binned GROUP BY model)""", body="""
SELECT b.model, bin, round(lo + bin * ((hi - lo) / 40), 6) AS left_edge, count(*) AS n,
       round(count(*) / (t * ((hi - lo) / 40)), 6) AS density
FROM binned b JOIN tot USING (model) GROUP BY b.model, bin, lo, hi, t"""))
def histogram(spark, sf):
    lines = A.lines(spark, sf)
    lo, hi = exact_quantiles(lines, [], "value", [0.005, 0.995]).first()["q"]
    return G.rounded(G.histogram(lines, ["model"], "value", 40, lo, hi), "left_edge", "density")


@query("agg20_ecdf", with_tables(A.ERRORS, body="""
SELECT DISTINCT model, ade_traj, round(cume_dist() OVER (PARTITION BY model ORDER BY ade_traj), 6) AS share FROM errors"""))
def ecdf(spark, sf):
    return G.rounded(G.ecdf(A.errors(spark, sf), ["model"], "ade_traj"), "share")


@query("agg21_rank_correlation", with_tables(A.LINES, """
r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY value) + (count(*) OVER (PARTITION BY model, value) - 1) / 2 AS rv,
             rank() OVER (PARTITION BY model ORDER BY quantity) + (count(*) OVER (PARTITION BY model, quantity) - 1) / 2 AS rq
      FROM lines)""", body="SELECT model, round(corr(rv, rq), 6) AS spearman, count(*) AS n FROM r GROUP BY model"))
def rank_correlation(spark, sf):
    return G.rounded(G.rank_correlation(A.lines(spark, sf), ["model"], "value", "quantity"), "spearman")


@query("agg22_linear_fit", with_tables(A.ERRORS, A.GAMES, body="""
SELECT year, round(regr_slope(ade_mean, n_traj), 6) AS slope, round(regr_intercept(ade_mean, n_traj), 6) AS intercept,
       round(corr(ade_mean, n_traj), 6) AS pearson FROM games GROUP BY year"""))
def linear_fit(spark, sf):
    out = A.games(spark, sf).groupBy("year").agg(
        F.regr_slope("ade_mean", "n_traj").alias("slope"), F.regr_intercept("ade_mean", "n_traj").alias("intercept"),
        F.corr("ade_mean", "n_traj").alias("pearson"))
    return G.rounded(out, "slope", "intercept", "pearson")


@query("agg23_weight_concentration", with_tables(A.ERRORS, A.WEIGHTED, """
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY w DESC, traj_id) AS k, count(*) OVER (PARTITION BY year) AS n
      FROM weighted)""", body="""
SELECT year, max(n) AS n, round(sum(w * ade_traj) / sum(w), 6) AS weighted_mean,
       round(sum(w) * sum(w) / (max(n) * sum(w * w)), 6) AS ess_ratio,
       round(sum(w) FILTER (k <= greatest(1, n // 100)) / sum(w) * 100, 6) AS top1_share_pct,
       round(sum(w) FILTER (k <= greatest(1, n // 20)) / sum(w) * 100, 6) AS top5_share_pct
FROM r GROUP BY year"""))
def weight_concentration(spark, sf):
    out = G.weight_concentration(A.weighted(spark, sf), ["year"], "w", "ade_traj", "traj_id")
    return G.rounded(out, "weighted_mean", "ess_ratio", "top1_share_pct", "top5_share_pct")


WILSON = """(k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS centre,
  1.96 / (1 + 3.8416 / n) * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) AS half"""


@query("agg24_wilson_interval", with_tables(A.ERRORS, f"""
c AS (SELECT model, year, count(*) AS n, count(*) FILTER (ade_traj > 9.3) AS k FROM errors GROUP BY ALL),
w AS (SELECT model, year, n, k, {WILSON} FROM c)""", body="""
SELECT model, year, n, k, round(greatest(0.0, centre - half) * 1000, 6) AS lo, round((centre + half) * 1000, 6) AS hi FROM w"""))
def wilson_interval(spark, sf):
    c = A.errors(spark, sf).groupBy("model", "year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ade_traj") > 9.3).alias("k"))
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    return G.rounded(c.withColumn("lo", lo).withColumn("hi", hi), "lo", "hi")


NORMS = ["x", "y", "vx", "vy"]


@query("agg26_normalisation_stats", with_tables(A.DETECTIONS, A.STEPS, body="SELECT " + ", ".join(
    f"round(avg({c}), 6) AS {n}_avg, round(stddev_pop({c}), 6) AS {n}_std" for c, n in
    [(c, c) for c in NORMS] + [("sin(y)", "sin"), ("cos(y)", "cos")]) + " FROM steps"))
def normalisation_stats(spark, sf):
    s = A.steps(spark, sf).withColumn("sin", F.sin("y")).withColumn("cos", F.cos("y"))
    names = [*NORMS, "sin", "cos"]
    out = s.agg(*[f(c).alias(f"{c}_{t}") for c in names for f, t in ((F.avg, "avg"), (F.stddev_pop, "std"))])
    return G.rounded(out, *out.columns)


@query("agg27_model_deltas", with_tables(A.ERRORS, body="""
SELECT year, round(avg(ade_traj) FILTER (model = '1-URGENT'), 6) AS ade, round(avg(fde_traj) FILTER (model = '1-URGENT'), 6) AS fde,
       round(avg(ade_traj) FILTER (model = '1-URGENT') - avg(ade_traj) FILTER (model = '5-LOW'), 6) AS ade_delta,
       round(avg(fde_traj) FILTER (model = '1-URGENT') - avg(fde_traj) FILTER (model = '5-LOW'), 6) AS fde_delta
FROM errors GROUP BY year"""))
def model_deltas(spark, sf):
    m = lambda c, n: F.avg(F.when(F.col("model") == n, F.col(c)))
    out = A.errors(spark, sf).groupBy("year").agg(
        m("ade_traj", "1-URGENT").alias("ade"), m("fde_traj", "1-URGENT").alias("fde"),
        (m("ade_traj", "1-URGENT") - m("ade_traj", "5-LOW")).alias("ade_delta"),
        (m("fde_traj", "1-URGENT") - m("fde_traj", "5-LOW")).alias("fde_delta"))
    return G.rounded(out, "ade", "fde", "ade_delta", "fde_delta")


ADAPT = """adapt AS (SELECT year, ade_traj AS before_e, ade_traj * (0.8 + (traj_id % 7) / 15) AS after_e FROM errors)"""


@query("agg28_adaptation", with_tables(A.ERRORS, ADAPT, f"""
m AS (SELECT year, avg(before_e) AS b, avg(after_e) AS a, avg(CASE WHEN after_e > before_e THEN 1.0 ELSE 0.0 END) AS cat,
      count(*) FILTER (after_e > before_e) AS n_deg, count(*) FILTER (after_e < before_e) AS n_imp FROM adapt GROUP BY year)""", body=f"""
SELECT m.year, round(m.cat, 6) AS cat_ratio, round(m.n_deg / greatest(m.n_imp, 1), 6) AS deg_per_imp,
       round((m.b - m.a) / nullif(m.b - r.b, 0) * 100, 4) AS recovery_pct, round((m.a - m.b) / m.b * 100, 6) AS delta_pct
FROM m JOIN m r ON r.year = {A.BASE_YEAR}"""))
def adaptation(spark, sf):
    """Errors before and after adaptation, joined on the row key."""
    e = A.errors(spark, sf)
    before = e.select("traj_id", "year", F.col("ade_traj").alias("before_e"))
    after = e.select("traj_id", (F.col("ade_traj") * (0.8 + (F.col("traj_id") % 7) / 15)).alias("after_e"))
    both = before.join(after, "traj_id")
    worse = F.col("after_e") > F.col("before_e")
    m = both.groupBy("year").agg(
        F.avg("before_e").alias("b"), F.avg("after_e").alias("a"), F.avg(worse.cast("double")).alias("cat_ratio"),
        (F.count_if(worse) / F.greatest(F.count_if(F.col("after_e") < F.col("before_e")), F.lit(1))).alias("deg_per_imp"))
    base = m.where(F.col("year") == A.BASE_YEAR).select("b").scalar()
    out = m.select(
        "year", "cat_ratio", "deg_per_imp",
        F.round(F.try_divide(F.col("b") - F.col("a"), F.nullif(F.col("b") - base, F.lit(0.0))) * 100, 4).alias("recovery_pct"),
        ((F.col("a") - F.col("b")) / F.col("b") * 100).alias("delta_pct"))
    return G.rounded(out, "cat_ratio", "deg_per_imp", "delta_pct")


@query("agg29_simple_shift", with_tables(A.ERRORS, f"""
m AS (SELECT year, avg(ade_traj) AS mean, stddev_pop(ade_traj) AS sd, max(ade_traj) AS top FROM errors GROUP BY year)""", body=f"""
SELECT m.year, round((m.mean - b.mean) / b.mean * 100, 6) AS mean_shift, round((m.sd - b.sd) / b.sd * 100, 6) AS sd_shift,
       round((m.top - b.top) / b.top * 100, 6) AS top_shift FROM m JOIN m b ON b.year = {A.BASE_YEAR}"""))
def simple_shift(spark, sf):
    m = A.errors(spark, sf).groupBy("year").agg(
        F.avg("ade_traj").alias("mean"), F.stddev_pop("ade_traj").alias("sd"), F.max("ade_traj").alias("top"))
    for c in ("mean", "sd", "top"):
        m = G.against_baseline(m, [], "year", A.BASE_YEAR, c, f"{c}_shift")
    return G.rounded(m.select("year", "mean_shift", "sd_shift", "top_shift"), "mean_shift", "sd_shift", "top_shift")


@query("agg30_multi_grain", with_tables(A.ERRORS, body="""
SELECT year, model, proc_set_file, count(*) AS n, round(avg(ade_traj), 6) AS ade FROM errors
GROUP BY GROUPING SETS ((year), (year, model), (proc_set_file), ())"""))
def multi_grain(spark, sf):
    e = A.errors(spark, sf)
    out = e.groupingSets([["year"], ["year", "model"], ["proc_set_file"], []], "year", "model", "proc_set_file").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ade_traj").alias("ade"))
    return G.rounded(out, "ade")


@query("agg32_probe_choice", with_tables(A.ERRORS, """
m AS (SELECT model, avg(ade_traj) AS a, avg(fde_traj - 4.5) AS b FROM errors GROUP BY model)""", body="""
SELECT model, round(a, 6) AS ade_velocity, round(b, 6) AS ade_increment,
       CASE WHEN a <= b THEN 'velocity' ELSE 'increment' END AS mode FROM m"""))
def probe_choice(spark, sf):
    """The reading of a forecast that fits the rows of a model better."""
    m = A.errors(spark, sf).groupBy("model").agg(
        F.avg("ade_traj").alias("ade_velocity"), F.avg(F.col("fde_traj") - 4.5).alias("ade_increment"))
    return G.rounded(m.withColumn("mode", F.when(
        F.col("ade_velocity") <= F.col("ade_increment"), "velocity").otherwise("increment")), "ade_velocity", "ade_increment")


@query("agg33_dataset_summary", with_tables(A.DETECTIONS, body="SELECT kind, count(*) AS n, " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_sd, min({c}) AS {c}_min, max({c}) AS {c}_max, "
    f"count(*) FILTER ({c} IS NULL OR isnan({c}) OR isinf({c})) AS {c}_bad" for c in ("x", "y")) + " FROM detections GROUP BY kind"))
def dataset_summary(spark, sf):
    from tidemark.schema import finite

    d = A.detections(spark, sf)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in ("x", "y"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"), F.min(c).alias(f"{c}_min"),
                 F.max(c).alias(f"{c}_max"), F.count_if(~finite(c) | F.col(c).isNull()).alias(f"{c}_bad")]
    return G.rounded(d.groupBy("kind").agg(*aggs), "x_mean", "x_sd", "y_mean", "y_sd")


