"""Queries over ordered series, samples and bootstraps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import poisson_sql, row_hash_sql, shuffled_sql, uniform_sql
from tidemark.functions.metrics import smoothed_snr, year_coverage, far_per_1k
from tidemark.functions.smoothing import polynomial_weights
from tidemark.operators import aggregates as G
from tidemark.operators import joins as J
from tidemark.operators import rankings as K
from tidemark.operators import sampling as M
from tidemark.operators import smoothers as W
from tidemark.operators.ordered import series
from tidemark.plans.catalog import query, with_tables
from tidemark.sources import adapters as A

POS = "(PARTITION BY model ORDER BY idx"


def by_idx(frame: str) -> str:
    return f"OVER {POS} ROWS BETWEEN {frame})"


# ---- order ----------------------------------------------------------------------

@query("win01_dense_index", """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events""")
def dense_index(spark, sf):
    return series(A.table(spark, sf, "events"), ["event_type"], ["ts", "event_id"]).df.select("event_type", "event_id", "idx")


@query("win02_rolling_mean", with_tables(A.ERRORS, A.STREAM, body=f"""
SELECT model, idx, round(avg(ade_traj) {by_idx('49 PRECEDING AND CURRENT ROW')}, 6) AS smooth FROM stream"""))
def rolling_mean(spark, sf):
    return G.rounded(W.rolling_mean(A.stream(spark, sf), "ade_traj", 50).select("model", "idx", "smooth"), "smooth")


@query("win03_rolling_median", with_tables(A.ERRORS, A.STREAM, body=f"""
SELECT model, idx, round(quantile_cont(ade_traj, 0.5) {by_idx('19 PRECEDING AND CURRENT ROW')}, 6) AS smooth FROM stream"""))
def rolling_median(spark, sf):
    return G.rounded(W.smooth(A.stream(spark, sf), "ade_traj", "med", {"w": 20}).select("model", "idx", "smooth"), "smooth")


ROBZ = f"""m AS (SELECT model, idx, year, ade_traj, count(*) {by_idx('39 PRECEDING AND CURRENT ROW')} AS n,
  quantile_cont(ade_traj, 0.5) {by_idx('39 PRECEDING AND CURRENT ROW')} AS med0 FROM stream),
d AS (SELECT *, CASE WHEN n >= 20 THEN med0 END AS med, CASE WHEN n >= 20 THEN abs(ade_traj - med0) END AS dev FROM m),
e AS (SELECT *, count(dev) {by_idx('39 PRECEDING AND CURRENT ROW')} AS n2, quantile_cont(dev, 0.5) {by_idx('39 PRECEDING AND CURRENT ROW')} AS mad0 FROM d),
robz AS (SELECT model, idx, year, coalesce((ade_traj - med) / coalesce(nullif(CASE WHEN n2 >= 20 THEN mad0 END, 0), 1), 0) AS z FROM e)"""


@query("win04_robust_z", with_tables(A.ERRORS, A.STREAM, ROBZ, body="SELECT model, idx, round(z, 6) AS smooth FROM robz"))
def robust_z(spark, sf):
    return G.rounded(W.smooth(A.stream(spark, sf), "ade_traj", "robz", {"w": 40}).select("model", "idx", "smooth"), "smooth")


@query("win05_ewma", with_tables(A.ERRORS, A.STREAM, """
r AS (SELECT model, idx, ade_traj AS s FROM stream WHERE idx = 0
      UNION ALL SELECT n.model, n.idx, 0.2 * n.ade_traj + 0.8 * r.s FROM r JOIN stream n ON n.model = r.model AND n.idx = r.idx + 1)""",
    body="SELECT model, idx, round(s, 6) AS smooth FROM r", recursive=True))
def ewma(spark, sf):
    return G.rounded(W.smooth(A.stream(spark, sf), "ade_traj", "ewma", {"alpha": 0.2}).select("model", "idx", "smooth"), "smooth")


@query("win06_holt", with_tables(A.ERRORS, A.STREAM, """
r AS (SELECT a.model, a.idx, a.ade_traj AS s, b.ade_traj - a.ade_traj AS b FROM stream a JOIN stream b ON a.model = b.model AND a.idx = 0 AND b.idx = 1
      UNION ALL SELECT n.model, n.idx, 0.3 * n.ade_traj + 0.7 * (r.s + r.b),
        0.1 * (0.3 * n.ade_traj + 0.7 * (r.s + r.b) - r.s) + 0.9 * r.b FROM r JOIN stream n ON n.model = r.model AND n.idx = r.idx + 1)""",
    body="SELECT model, idx, round(s, 6) AS smooth FROM r", recursive=True))
def holt(spark, sf):
    out = W.smooth(A.stream(spark, sf), "ade_traj", "holt", {"alpha": 0.3, "beta": 0.1})
    return G.rounded(out.select("model", "idx", "smooth"), "smooth")


def polynomial_sql(w: int, degree: int) -> str:
    """The filter in SQL: row r of the weights for the r-th of w rows, w rows around each position."""
    table = "[" + ", ".join(repr(float(v)) for row in polynomial_weights(w, degree) for v in row) + "]"
    return f"""wt AS (SELECT {table} AS wt), xs AS (SELECT model, list(ade_traj ORDER BY idx) AS xs, count(*) AS n FROM stream GROUP BY model),
spot AS (SELECT model, idx, xs, greatest(0, least(idx - {w // 2}, n - {w})) AS start FROM stream JOIN xs USING (model)),
sm AS (SELECT model, idx, list_sum(list_transform(range(1, {w + 1}), lambda j: wt[(idx - start) * {w} + j] * xs[start + j])) AS smooth FROM spot, wt)"""


@query("win07_local_polynomial", with_tables(A.ERRORS, A.STREAM, polynomial_sql(51, 3), body="SELECT model, idx, round(smooth, 6) AS smooth FROM sm"))
def local_polynomial(spark, sf):
    out = W.smooth(A.stream(spark, sf), "ade_traj", "savgol", {"w": 51, "degree": 3})
    return G.rounded(out.select("model", "idx", "smooth"), "smooth")


@query("win08_first_difference", with_tables(A.ERRORS, A.STREAM, body="""
SELECT model, idx, round(ade_traj - lag(ade_traj) OVER (PARTITION BY model ORDER BY idx), 6) AS diff FROM stream"""))
def first_difference(spark, sf):
    return G.rounded(W.first_difference(A.stream(spark, sf), "ade_traj").select("model", "idx", "diff"), "diff")


@query("win09_cumulative_sum", with_tables(A.DETECTIONS, A.STEPS, body="""
SELECT robot_id, pos, round(sum(vx) OVER (PARTITION BY robot_id ORDER BY pos), 4) AS total FROM steps"""))
def cumulative_sum(spark, sf):
    s = series(A.steps(spark, sf), ["robot_id"], ["pos"])
    return G.rounded(W.cumulative_sum(s, "vx").select("robot_id", "pos", "total"), "total", digits=4)


@query("win10_sliding_windows", with_tables(A.DETECTIONS, """
p AS (SELECT robot_id, frame, x, row_number() OVER (PARTITION BY robot_id ORDER BY t, frame) - 1 AS idx, count(*) OVER (PARTITION BY robot_id) AS n FROM detections),
w AS (SELECT robot_id, idx, n, list(x) OVER (PARTITION BY robot_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS v FROM p)""", body="""
SELECT robot_id, idx, round(list_avg(v[1:6]), 6) AS past_mean, v[6] AS last_seen, v[9] AS last_true FROM w WHERE idx < n - 9"""))
def sliding_windows(spark, sf):
    from tidemark.functions.scalars import array_mean

    s = series(A.detections(spark, sf), ["robot_id"], ["t", "frame"])
    w = W.sliding_windows(s, 6, 3, ["x"])
    return w.select("robot_id", "idx", F.round(array_mean(F.col("past_x")), 6).alias("past_mean"),
                    F.element_at("past_x", -1).alias("last_seen"), F.element_at("future_x", -1).alias("last_true"))


@query("win11_game_chunks", with_tables(A.ERRORS, """
g AS (SELECT proc_set_file, traj_id, ade_traj, CAST((row_number() OVER (PARTITION BY proc_set_file ORDER BY year, traj_id) - 1) // 30 AS INTEGER) AS window_id FROM errors)""",
    body="SELECT proc_set_file, window_id, count(*) AS n, round(avg(ade_traj), 6) AS ade FROM g GROUP BY ALL"))
def game_chunks(spark, sf):
    c = G.game_chunks(A.errors(spark, sf), "proc_set_file", ["year", "traj_id"], 30)
    return G.rounded(c.groupBy("proc_set_file", "window_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ade_traj").alias("ade")), "ade")


# four limits stand for four detectors
LIMITS = [9.0, 9.3, 9.6, 9.9]
SCORES = f"""lim AS (SELECT unnest([{", ".join(map(str, LIMITS))}]) AS lim),
tot AS (SELECT model, count(*) FILTER (year = {A.BASE_YEAR}) AS base_rows, count(*) FILTER (year > {A.BASE_YEAR}) AS post_rows FROM errors GROUP BY model),
sc AS (SELECT e.model, e.model || '@' || lim AS detector, base_rows, post_rows, count(*) FILTER (ade_traj > lim AND year = {A.BASE_YEAR}) AS n_base,
  count(*) FILTER (ade_traj > lim AND year > {A.BASE_YEAR}) AS n_post,
  {" + ".join(f"CASE WHEN count(*) FILTER (ade_traj > lim AND year = {y}) > 6 THEN 1 ELSE 0 END" for y in A.POST_YEARS)} AS year_coverage
  FROM errors e, lim JOIN tot ON true WHERE tot.model = e.model GROUP BY ALL),
scores AS (SELECT *, 1000.0 * n_base / greatest(1, base_rows) AS far_per_1k,
  (n_post + 1.0) * base_rows / ((n_base + 1.0) * post_rows) AS snr_smooth FROM sc)"""


def scores(spark, sf):
    """Detector scores of limit crossings, one detector per model and limit."""
    e = A.errors(spark, sf)
    x = e.withColumn("lim", F.explode(F.array(*[F.lit(v) for v in LIMITS])))
    hit = F.col("ade_traj") > F.col("lim")
    agg = x.groupBy("model", F.concat(F.col("model"), F.lit("@"), F.col("lim").cast("string")).alias("detector")).agg(
        F.count_if(hit & (F.col("year") == A.BASE_YEAR)).alias("n_base"), F.count_if(hit & (F.col("year") > A.BASE_YEAR)).alias("n_post"),
        *[F.count_if(hit & (F.col("year") == y)).alias(f"n_{y}") for y in A.POST_YEARS])
    agg = agg.join(J.small(A.totals(e, ["model"])), "model")
    return agg.select(
        "model", "detector", "n_base", "n_post", "base_rows", "post_rows",
        year_coverage([F.col(f"n_{y}") - 6 for y in A.POST_YEARS]).alias("year_coverage"),
        far_per_1k(F.col("n_base"), F.col("base_rows")).alias("far_per_1k"),
        smoothed_snr(F.col("n_post"), F.col("n_base"), F.col("base_rows"), F.col("post_rows")).alias("snr_smooth"))


ORDER = "year_coverage DESC, far_per_1k, snr_smooth DESC, detector"


@query("win12_rank_rule", with_tables(A.ERRORS, SCORES, body=f"""
SELECT detector, CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS place, CAST(year_coverage AS INTEGER) AS year_coverage, round(far_per_1k, 6) AS far_per_1k FROM scores"""))
def rank_rule(spark, sf):
    out = K.rank_rule(scores(spark, sf).withColumn("_all", F.lit(1)), ["_all"], "place", ["detector"])
    return G.rounded(out.select("detector", "place", "year_coverage", "far_per_1k"), "far_per_1k")


@query("win13_rank_stability", with_tables(A.ERRORS, SCORES, """
x AS (SELECT a, detector, year_coverage, far_per_1k, (n_post + a) * base_rows / ((n_base + a) * post_rows) AS snr_smooth
      FROM scores, (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS a))""", body=f"""
SELECT a, CAST(row_number() OVER (PARTITION BY a ORDER BY {ORDER}) AS INTEGER) AS place, detector, CAST(year_coverage AS INTEGER) AS year_coverage,
  round(far_per_1k, 6) AS far_per_1k, round(snr_smooth, 6) AS snr_smooth FROM x"""))
def rank_stability(spark, sf):
    return G.rounded(K.rank_stability(scores(spark, sf).drop("snr_smooth"), "detector", [0.5, 1.0, 2.0]), "far_per_1k", "snr_smooth")


@query("win14_year_boundaries", with_tables(A.ERRORS, A.STREAM, A.ALARMS, """
b AS (SELECT model, year, min(idx) AS boundary, count(*) AS n_rows FROM stream GROUP BY model, year)""", body="""
SELECT b.model, b.year, boundary, n_rows, min(a.idx) AS first_alarm, count(a.idx) AS n_alarms, min(a.idx) - boundary AS delay
FROM b LEFT JOIN alarms a ON a.model = b.model AND a.idx >= boundary AND a.idx < boundary + n_rows GROUP BY b.model, b.year, boundary, n_rows"""))
def year_boundaries(spark, sf):
    return W.first_after(W.boundaries(A.stream(spark, sf), "year"), A.alarms(spark, sf), ["model"])


@query("win15_autocorrelation", with_tables(A.ERRORS, A.STREAM, """
m AS (SELECT model, avg(ade_traj) AS mu, count(*) AS n FROM stream GROUP BY model),
c AS (SELECT s.model, idx, ade_traj - mu AS x, n FROM stream s JOIN m USING (model)), v AS (SELECT model, sum(x * x) AS v FROM c GROUP BY model),
p AS (SELECT a.model, k.lag, a.n, sum(a.x * b.x) AS s FROM c a, (SELECT CAST(unnest(range(0, 21)) AS INTEGER) AS lag) k, c b WHERE b.model = a.model AND b.idx = a.idx - k.lag GROUP BY ALL)""",
    body="SELECT model, lag, n, round(s / v, 6) AS rho FROM p JOIN v USING (model)"))
def autocorrelation(spark, sf):
    return G.rounded(G.autocorrelation(A.stream(spark, sf), "ade_traj", 20), "rho")


@query("win15_effective_size", with_tables(A.ERRORS, A.STREAM, """
s40 AS (SELECT model, idx, avg(ade_traj) OVER (PARTITION BY model ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS y FROM stream),
m AS (SELECT model, avg(y) AS mu, count(*) AS n FROM s40 GROUP BY model), c AS (SELECT s.model, idx, y - mu AS x, n FROM s40 s JOIN m USING (model)),
v AS (SELECT model, sum(x * x) AS v FROM c GROUP BY model),
p AS (SELECT a.model, k.lag, a.n, sum(a.x * b.x) AS s FROM c a, (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS lag) k, c b WHERE b.model = a.model AND b.idx = a.idx - k.lag GROUP BY ALL),
r AS (SELECT model, lag, n, s / v AS rho FROM p JOIN v USING (model)),
f AS (SELECT model, coalesce(min(lag) FILTER (abs(rho) < 1.96 / sqrt(n)), 20) AS cut_lag, coalesce(min(lag) FILTER (abs(rho) < 1.96 / sqrt(n)), 21) AS stop FROM r GROUP BY model)""",
    body="SELECT model, max(n) AS n, max(cut_lag) AS cut_lag, round(max(n) / (1 + 2 * coalesce(sum(rho) FILTER (lag < stop), 0)), 4) AS n_eff FROM r JOIN f USING (model) GROUP BY model"))
def effective_size(spark, sf):
    s = A.stream(spark, sf)
    smooth = s.using(W.rolling_mean(s, "ade_traj", 5))
    return G.rounded(G.effective_size(G.autocorrelation(smooth, "smooth", 20), ["model"]), "n_eff", digits=4)


@query("win16_mean_split_scores", with_tables(A.ERRORS, A.STREAM, """
c AS (SELECT model, idx, ade_traj, coalesce(sum(ade_traj) OVER (PARTITION BY model ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
  coalesce(sum(ade_traj * ade_traj) OVER (PARTITION BY model ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM stream),
r AS (SELECT model, idx, s + ade_traj AS se, q + ade_traj * ade_traj AS qe, least(idx + 1, 300) AS n FROM c),
l AS (SELECT *, idx - n + 1 AS lft, idx - n + 1 + n // 2 AS cut FROM r),
j AS (SELECT l.model, l.idx, n, n // 2 AS na, n - n // 2 AS nb, k.s - a.s AS sa, k.q - a.q AS qa, se - k.s AS sb, qe - k.q AS qb
      FROM l JOIN c a ON a.model = l.model AND a.idx = l.lft JOIN c k ON k.model = l.model AND k.idx = l.cut),
z AS (SELECT model, idx, n, abs(sa / na - sb / nb) / sqrt(greatest(qa - sa * sa / na, 0) / (na - 1) / na + greatest(qb - sb * sb / nb, 0) / (nb - 1) / nb) AS z FROM j WHERE na >= 2 AND nb >= 2)""",
    body="SELECT model, idx, n AS length, round(z, 5) AS z FROM z WHERE n >= 40"))
def mean_split_scores(spark, sf):
    out = W.mean_split_scores(A.stream(spark, sf), "ade_traj", 300).where("length >= 40")
    return G.rounded(out, "z", digits=5)


@query("win17_hinkley_scores", with_tables(A.ERRORS, A.STREAM, """
a AS (SELECT model, idx, ade_traj - avg(ade_traj) OVER (PARTITION BY model ORDER BY idx) - 0.05 AS dev FROM stream),
b AS (SELECT model, idx, sum(dev) OVER (PARTITION BY model ORDER BY idx) AS s FROM a)""",
    body="SELECT model, idx, round(s - least(min(s) OVER (PARTITION BY model ORDER BY idx), 0), 5) AS excess FROM b"))
def hinkley_scores(spark, sf):
    return G.rounded(W.hinkley_scores(A.stream(spark, sf), "ade_traj", 0.05), "excess", digits=5)


@query("win18_interleaved_tracks", with_tables(A.DETECTIONS, """
s AS (SELECT game, team, robot_id, min(t) AS t0, count(*) AS n FROM detections GROUP BY ALL)""", body="""
SELECT game, team, robot_id, round(t0, 3) AS t0, n, row_number() OVER (PARTITION BY game ORDER BY t0, team, robot_id) - 1 AS place FROM s"""))
def interleaved_tracks(spark, sf):
    return G.rounded(W.interleaved(A.detections(spark, sf), "game", ["team", "robot_id"], "t"), "t0", digits=3)


@query("agg25_variance_reduction", with_tables(A.ERRORS, A.STREAM, f"""
s AS (SELECT model, ade_traj, avg(ade_traj) {by_idx('19 PRECEDING AND CURRENT ROW')} AS y FROM stream)""",
    body="SELECT model, round((var_pop(ade_traj) - var_pop(y)) / var_pop(ade_traj) * 100, 6) AS reduction_pct FROM s GROUP BY model"))
def variance_reduction(spark, sf):
    r = W.rolling_mean(A.stream(spark, sf), "ade_traj", 20)
    return G.rounded(W.variance_reduction(r, ["model"], "ade_traj", "smooth"), "reduction_pct")


# ---- sort and top ------------------------------------------------------------------

@query("srt01_multi_key", with_tables(A.ERRORS, A.GAMES, body="SELECT year, proc_set_file, round(ade_mean, 6) AS ade_mean FROM games ORDER BY year DESC, ade_mean, proc_set_file"))
def multi_key(spark, sf):
    return G.rounded(A.games(spark, sf).orderBy(F.desc("year"), "ade_mean", "proc_set_file").select("year", "proc_set_file", "ade_mean"), "ade_mean")


@query("srt02_top_k", with_tables(A.ERRORS, body="""
SELECT model, traj_id, round(ade_traj, 6) AS ade_traj FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ade_traj DESC, traj_id) AS k FROM errors) WHERE k <= 5"""))
def top_k(spark, sf):
    """The five largest errors per model; tasks keep five rows each before the shuffle."""
    w = Window.partitionBy("model").orderBy(F.desc("ade_traj"), "traj_id")
    best = A.errors(spark, sf).withColumn("_r", F.row_number().over(w)).where("_r <= 5")
    return G.rounded(best.select("model", "traj_id", "ade_traj"), "ade_traj")


@query("srt03_decimation", with_tables(A.ERRORS, A.STREAM, body="SELECT model, idx, traj_id FROM stream WHERE idx % 10 = 0"))
def decimation(spark, sf):
    return A.stream(spark, sf).df.where("idx % 10 = 0").select("model", "idx", "traj_id")


# ---- samples -------------------------------------------------------------------------

H = row_hash_sql("traj_id", "'42'")


@query("smp02_per_game_cap", with_tables(A.ERRORS, f"r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY {H}, traj_id) AS k FROM errors)",
       body="SELECT match_id, traj_id FROM r WHERE k <= 80"))
def per_game_cap(spark, sf):
    return M.hash_cap(A.errors(spark, sf), ["match_id"], "traj_id", 80).select("match_id", "traj_id")


@query("smp03_stratified_games", with_tables(A.ERRORS, f"""
g AS (SELECT DISTINCT year, proc_set_file FROM errors),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY {row_hash_sql("(year || '_' || proc_set_file)", "'42'")}, proc_set_file) AS k FROM g)""",
    body=f"SELECT year, proc_set_file FROM r WHERE k <= 3 OR year = {A.BASE_YEAR}"))
def stratified_games(spark, sf):
    return M.stratified_units(A.errors(spark, sf), "year", "proc_set_file", 3, [A.BASE_YEAR])


DRAW = f"""picks AS (SELECT d AS draw, {uniform_sql('d', '0')} AS u FROM (SELECT unnest(range(1, 401)) AS d))"""


@query("smp04_weighted_replay", with_tables(A.ERRORS, A.WEIGHTED, DRAW, """
c AS (SELECT traj_id, coalesce(sum(w) OVER (ORDER BY traj_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER () AS lo,
      sum(w) OVER (ORDER BY traj_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(w) OVER () AS hi FROM weighted)""",
    body="SELECT draw, traj_id FROM picks JOIN c ON u >= lo AND u < hi"))
def weighted_replay(spark, sf):
    return M.weighted_draws(A.weighted(spark, sf).select("traj_id", "w"), "w", "traj_id", 400).select("draw", "traj_id")


@query("smp05_train_validation", with_tables(A.ERRORS, body=f"""
SELECT CASE WHEN {H} / 4294967296.0 < 0.1 THEN 'validation' ELSE 'train' END AS part, count(*) AS n, sum(traj_id)::BIGINT AS ids FROM errors GROUP BY 1"""))
def train_validation(spark, sf):
    return M.train_validation(A.errors(spark, sf), "traj_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("traj_id").alias("ids"))


FOLDS = """folds AS (SELECT year, match_id, CASE WHEN (row_number() OVER (PARTITION BY year ORDER BY match_id) - 1) % 2 = 0 THEN 'calib' ELSE 'test' END AS split
  FROM (SELECT DISTINCT year, match_id FROM errors))"""


@query("smp05_game_folds", with_tables(A.ERRORS, FOLDS, body="SELECT year, match_id, split FROM folds"))
def game_folds(spark, sf):
    return M.game_folds(A.errors(spark, sf), "year", "match_id")


REPS = BLOCK_REPS = 2000
BOOT = f"""reps AS (SELECT unnest(range(0, {REPS})) AS rep),
u AS (SELECT year, ade_traj, rep, {uniform_sql('traj_id', 'rep')} AS u FROM errors, reps),
k AS (SELECT *, {poisson_sql('u')} AS k FROM u)"""


@query("smp06_bootstrap_mean", with_tables(A.ERRORS, BOOT, """
m AS (SELECT year, rep, sum(k * ade_traj) / sum(k) AS m FROM k GROUP BY year, rep)""", body="""
SELECT e.year, round(avg(ade_traj), 6) AS mean, count(*) AS n, max(lo) AS lo, max(hi) AS hi FROM errors e
JOIN (SELECT year, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY year) q ON q.year = e.year GROUP BY e.year"""))
def bootstrap_mean(spark, sf):
    return G.rounded(M.bootstrap_mean(A.errors(spark, sf), ["year"], "ade_traj", "traj_id", REPS), "mean", "lo", "hi")


@query("smp07_weighted_bootstrap", with_tables(A.ERRORS, f"""
w AS (SELECT traj_id, year, ade_traj, 1 + traj_id * 7919 % 101 / 25 AS w FROM errors), reps AS (SELECT unnest(range(0, {REPS})) AS rep),
u AS (SELECT w.*, rep, {uniform_sql('traj_id', 'rep')} AS u FROM w, reps), k AS (SELECT *, {poisson_sql('u')} AS k FROM u),
b AS (SELECT rep, sum(k * ade_traj) / sum(k) AS base FROM k WHERE year = {A.BASE_YEAR} GROUP BY rep),
r AS (SELECT year, rep, sum(k * ade_traj) / sum(k) AS m, sum(k * w * ade_traj) / sum(k * w) AS iw FROM k WHERE year > {A.BASE_YEAR} GROUP BY year, rep),
s AS (SELECT year, iw, m - iw AS correction, CASE WHEN m - base > 1e-6 THEN (m - iw) / (m - base) * 100 END AS rec FROM r JOIN b USING (rep))""", body="""
SELECT year, round(quantile_cont(iw, 0.025), 6) AS iw_lo, round(quantile_cont(iw, 0.975), 6) AS iw_hi, round(quantile_cont(rec, 0.025), 4) AS rec_lo,
       round(quantile_cont(rec, 0.975), 4) AS rec_hi FROM s GROUP BY year"""))
def weighted_bootstrap(spark, sf):
    w = A.weighted(spark, sf)
    base = M.replicate_sums(w.where(F.col("year") == A.BASE_YEAR), [], F.col("traj_id"), REPS, {"s": F.col("ade_traj")})
    reps = M.bootstrap_weighted(w.where(F.col("year") > A.BASE_YEAR), base.select("rep", (F.col("s") / F.col("n")).alias("base_mean")),
                                ["year"], "ade_traj", "w", "traj_id", REPS)
    iw = M.interval(reps, ["year"], "iw").withColumnsRenamed({"lo": "iw_lo", "hi": "iw_hi"})
    rec = M.interval(reps, ["year"], "recovery").withColumnsRenamed({"lo": "rec_lo", "hi": "rec_hi"})
    return G.rounded(G.rounded(iw.join(rec, "year", "left"), "iw_lo", "iw_hi"), "rec_lo", "rec_hi", digits=4)


@query("smp08_block_bootstrap", with_tables(A.ERRORS, A.WEIGHTED, f"""
bl AS (SELECT year, proc_set_file, count(*) AS n, sum(ade_traj) AS sx, sum(w) AS sw, sum(w * ade_traj) AS swx FROM weighted GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY proc_set_file) - 1 AS rank, count(*) OVER (PARTITION BY year) AS m FROM bl),
dr AS (SELECT year, rank AS d, m, rep FROM rk, (SELECT unnest(range(0, {BLOCK_REPS})) AS rep)),
pk AS (SELECT year, rep, CAST(floor({uniform_sql('d + 1', 'rep')} * m) AS BIGINT) AS rank FROM dr),
s AS (SELECT year, rep, sum(n) AS n, sum(sx) AS sx, sum(sw) AS sw, sum(swx) AS swx FROM pk JOIN rk USING (year, rank) GROUP BY year, rep)""", body="""
SELECT year, round(quantile_cont(sx / n - swx / sw, 0.025), 6) AS lo, round(quantile_cont(sx / n - swx / sw, 0.975), 6) AS hi FROM s GROUP BY year"""))
def block_bootstrap(spark, sf):
    blocks = M.block_sums(A.weighted(spark, sf), ["year"], "proc_set_file", "ade_traj", "w")
    reps = M.block_draws(blocks, ["year"], "proc_set_file", BLOCK_REPS, ["n", "sx", "sw", "swx"])
    reps = reps.withColumn("correction", F.col("sx") / F.col("n") - F.col("swx") / F.col("sw"))
    return G.rounded(M.interval(reps, ["year"], "correction"), "lo", "hi")


@query("smp09_line_band", with_tables(A.ERRORS, f"""
g AS (SELECT proc_set_file, year, year * 10 + CAST(substr(proc_set_file, 2) AS BIGINT) AS gid, count(*) / 10 AS x, avg(ade_traj) AS y FROM errors GROUP BY ALL),
k AS (SELECT g.*, rep, {poisson_sql(uniform_sql('gid', 'rep'))} AS k FROM g, (SELECT unnest(range(0, {BLOCK_REPS})) AS rep)),
s AS (SELECT rep, sum(k) AS n, sum(k * x) AS sx, sum(k * y) AS sy, sum(k * x * y) AS sxy, sum(k * x * x) AS sxx FROM k GROUP BY rep),
f AS (SELECT rep, (sxy / n - sx / n * sy / n) / (sxx / n - (sx / n) * (sx / n)) AS b, sx / n AS mx, sy / n AS my FROM s),
p AS (SELECT x, my - b * mx + b * x AS pred FROM f, (SELECT unnest([20.0, 30.0, 40.0, 50.0, 60.0])::DOUBLE AS x))""", body="""
SELECT x, round(avg(pred), 5) AS mean, round(quantile_cont(pred, 0.025), 5) AS lo, round(quantile_cont(pred, 0.975), 5) AS hi FROM p GROUP BY x"""))
def line_band(spark, sf):
    g = A.games(spark, sf).select(
        (F.col("year") * 10 + F.substring("proc_set_file", 2, 9).cast("bigint")).alias("gid"), (F.col("n_traj") / 10).alias("x"), F.col("ade_mean").alias("y"))
    fits = M.line_replicates(g, [], "x", "y", "gid", BLOCK_REPS)
    grid = A.table(spark, sf, "region").select((F.col("r_regionkey") * 10 + 20.0).alias("x"))
    return G.rounded(M.line_band(fits, [], grid), "mean", "lo", "hi", digits=5)


PERMUTED = 3
ROWS = f"""base AS (SELECT model, match_id, traj_id, row_number() OVER (PARTITION BY model ORDER BY idx) - 1 AS idx FROM stream WHERE year = {A.BASE_YEAR}),
r AS (SELECT unnest(range(0, {PERMUTED})) AS rep),
b AS (SELECT *, row_number() OVER (PARTITION BY model, match_id ORDER BY idx) - 1 AS o, count(*) OVER (PARTITION BY model) AS n FROM base),
bl AS (SELECT model, match_id, count(*) AS m, min(idx) AS first FROM base GROUP BY ALL),
bk AS (SELECT model, match_id, m, row_number() OVER w - 1 AS rank, count(*) OVER (PARTITION BY model) AS nb,
              coalesce(sum(m) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM bl WINDOW w AS (PARTITION BY model ORDER BY first)),
f0 AS (SELECT * FROM b, r), w0 AS (SELECT b.*, m, start, rep FROM b JOIN bk USING (model, match_id), r), k0 AS (SELECT * FROM bk, r)"""


@query("smp10_permuted_order", with_tables(
    A.ERRORS, A.STREAM, ROWS, shuffled_sql("f0", "f", "idx", "n", "0", "rep", "pos"), shuffled_sql("w0", "w", "o", "m", "start", "rep", "turn"),
    shuffled_sql("k0", "k", "rank", "nb", "0", "rep", "turn"),
    "kb AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY model, rep ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start2 FROM k)", body="""
SELECT 'full' AS scheme, model, CAST(rep AS INTEGER) AS rep, traj_id, pos FROM f
UNION ALL SELECT 'within', model, CAST(rep AS INTEGER), traj_id, start + turn FROM w
UNION ALL SELECT 'blocks', b.model, CAST(rep AS INTEGER), traj_id, start2 + o FROM b JOIN kb USING (model, match_id)"""))
def permuted_order(spark, sf):
    base = A.stream(spark, sf).df.where(F.col("year") == A.BASE_YEAR).select("model", "match_id", F.col("idx").alias("at"), "traj_id")
    s, out = series(base, ["model"], ["at"]), None
    for scheme in ("full", "within", "blocks"):
        p = M.permuted(s, scheme, "match_id", PERMUTED)
        part = p.df.select(F.lit(scheme).alias("scheme"), "model", "rep", "traj_id", F.col(p.idx).alias("pos"))
        out = part if out is None else out.unionByName(part)
    return out


@query("smp11_baseline_sweep", with_tables(A.ERRORS, f"""
g AS (SELECT proc_set_file, year, count(*) AS n, sum(ade_traj) AS sx, {row_hash_sql('proc_set_file', "'42'")} AS gid FROM errors GROUP BY ALL),
d AS (SELECT g.*, n_games, rep, {uniform_sql('gid', 'rep * 31 + n_games')} AS u FROM g, (SELECT unnest(range(1, 7)) AS n_games), (SELECT unnest(range(0, 50)) AS rep) WHERE year = {A.BASE_YEAR}),
r AS (SELECT *, row_number() OVER (PARTITION BY n_games, rep ORDER BY u, proc_set_file) AS k FROM d),
b AS (SELECT n_games, rep, sum(sx) / sum(n) AS base FROM r WHERE k <= n_games GROUP BY n_games, rep),
t AS (SELECT year, sum(sx) / sum(n) AS ade FROM g WHERE year <> {A.BASE_YEAR} GROUP BY year),
e AS (SELECT n_games, year, ade - base AS x FROM b, t)""", body="""
SELECT CAST(n_games AS INTEGER) AS n_games, year, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q25,
       round(quantile_cont(x, 0.75), 6) AS q75, round(stddev_pop(x), 6) AS std FROM e GROUP BY n_games, year"""))
def baseline_sweep(spark, sf):
    g = A.errors(spark, sf).groupBy("proc_set_file", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("ade_traj").alias("sx"))
    return G.rounded(M.sweep_summary(M.baseline_size_sweep(g, A.BASE_YEAR, 6, 50)), "median", "q25", "q75", "std")


@query("agg31_relative_years", with_tables(A.ERRORS, A.GAMES, """
m AS (SELECT year, avg(ade_mean) AS ade, quantile_cont(ade_mean, 0.5) AS med, sum(n_traj)::BIGINT AS n FROM games WHERE year <> 1998 GROUP BY year),
d AS (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS year)""", body=f"""
SELECT d.year, round(ade / (SELECT ade FROM m WHERE year = {A.BASE_YEAR}), 6) AS relative, round(med, 6) AS med, n FROM d LEFT JOIN m USING (year)"""))
def relative_years(spark, sf):
    g = A.games(spark, sf)
    years = g.select("year").distinct()
    m = g.where("year <> 1998").groupBy("year").agg(
        F.avg("ade_mean").alias("ade"), F.expr("percentile(ade_mean, 0.5)").alias("med"), F.sum("n_traj").alias("n"))
    base = m.where(F.col("year") == A.BASE_YEAR).select("ade").scalar()
    out = years.join(m, "year", "left").withColumn("relative", F.col("ade") / base)
    return G.rounded(out.select("year", "relative", "med", "n"), "relative", "med")


