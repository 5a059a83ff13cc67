"""Queries over distribution distances, features and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import scalars
from tidemark.functions.hashing import poisson_sql, row_hash_sql, uniform_sql
from tidemark.operators import aggregates as G
from tidemark.operators import distance as D
from tidemark.operators import joins as J
from tidemark.operators import sampling as M
from tidemark.operators import tracks as T
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.catalog import query, with_tables
from tidemark.sources import adapters as A

# KS of a group against the common baseline, in SQL: both ECDFs on the joint axis
def ks_sql(groups: str, base: str, by: str) -> str:
    """``groups`` has (key..., value), ``base`` has (shared..., value)."""
    return f"""SELECT {by}, max(abs(fa - fb)) AS ks FROM (
  SELECT {by}, count(*) FILTER (a = 1) OVER w / nullif(count(*) FILTER (a = 1) OVER p, 0) AS fa,
         count(*) FILTER (a = 0) OVER w / nullif(count(*) FILTER (a = 0) OVER p, 0) AS fb
  FROM (SELECT {by}, value, 1 AS a FROM {groups} UNION ALL SELECT {by}, value, 0 FROM {base})
  WINDOW w AS (PARTITION BY {by} ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY {by}))
  GROUP BY {by}"""


def grid_sql(source: str, by: str, points: int = 2000) -> str:
    """Quantile grids as lists."""
    return f"SELECT {by}, quantile_cont(value, list_transform(range({points}), lambda i: i / {points - 1}.0)) AS q FROM {source} GROUP BY {by}"


WD = "list_avg(list_transform(list_zip(a.q, b.q), lambda z: abs(z[1] - z[2])))"

SIDES = f"""s AS (SELECT model, year = {A.BASE_YEAR} AS in_a, value FROM lines WHERE year IN ({A.BASE_YEAR}, 2000)),
ga AS (SELECT model, value FROM s WHERE in_a), gb AS (SELECT model, value FROM s WHERE NOT in_a)"""


def two_periods(spark, sf):
    return A.lines(spark, sf).where(F.col("year").isin(A.BASE_YEAR, 2000))


@query("dst01_ks_statistic", with_tables(A.LINES, SIDES, f"k AS ({ks_sql('ga', 'gb', 'model')})", body="""
SELECT k.model, (SELECT count(*) FROM ga WHERE ga.model = k.model) AS n_a, (SELECT count(*) FROM gb WHERE gb.model = k.model) AS n_b, round(ks, 6) AS ks FROM k"""))
def ks_statistic(spark, sf):
    return G.rounded(D.ks_two_sample(two_periods(spark, sf), ["model"], "value", F.col("year") == A.BASE_YEAR), "ks")


@query("dst02_wasserstein", with_tables(A.LINES, SIDES, f"qa AS ({grid_sql('ga', 'model')}), qb AS ({grid_sql('gb', 'model')})",
       body=f"SELECT a.model, round({WD}, 6) AS wd FROM qa a JOIN qb b ON a.model = b.model"))
def wasserstein(spark, sf):
    return G.rounded(D.wasserstein_two_sample(two_periods(spark, sf), ["model"], "value", F.col("year") == A.BASE_YEAR), "wd")


FEATURES = """k0 AS (SELECT game, robot_id, pos, sqrt(vx * vx + vy * vy) * 40 AS speed, vx, vy,
  atan2(vy, vx) - lag(atan2(vy, vx)) OVER (PARTITION BY robot_id ORDER BY pos) AS dh,
  sqrt(pow(vx - lag(vx) OVER (PARTITION BY robot_id ORDER BY pos), 2) + pow(vy - lag(vy) OVER (PARTITION BY robot_id ORDER BY pos), 2)) AS accel FROM steps),
k1 AS (SELECT game, robot_id, pos, speed, accel * 3 AS accel, abs(((dh + pi()) - 2 * pi() * floor((dh + pi()) / (2 * pi()))) - pi()) AS turn FROM k0 WHERE dh IS NOT NULL),
raw AS (SELECT game, robot_id, pos, 'speed' AS feature, speed AS value FROM k1 UNION ALL SELECT game, robot_id, pos, 'accel', accel FROM k1 UNION ALL SELECT game, robot_id, pos, 'turn', turn FROM k1),
feats AS (SELECT game, robot_id, pos, feature, CASE feature WHEN 'speed' THEN least(value, 8000.0) WHEN 'accel' THEN least(value, 500.0) ELSE value END AS value FROM raw)"""
TRACKED = (A.DETECTIONS, A.STEPS, FEATURES)


def features(spark, sf, clipped=True):
    """Speed, acceleration and turn of every step, stacked, optionally capped."""
    k = T.kinematics(A.steps(spark, sf), ["robot_id"], "pos").where("accel IS NOT NULL")
    long = D.melt_features(k, ["game", "robot_id", "pos"], {
        "speed": F.col("speed") * 40, "accel": F.col("accel") * 3, "turn": F.col("turn")})
    return long.withColumn("value", scalars.robust_clip(F.col("feature"), F.col("value"))) if clipped else long


GROUPS = """gr AS (SELECT game, feature, value FROM feats), bs AS (SELECT g.game, feature, value FROM feats f, (SELECT DISTINCT game FROM feats) g WHERE f.game IN ('g0', 'g1'))"""


@query("dst03_shift_per_game", with_tables(*TRACKED, GROUPS, f"k AS ({ks_sql('gr', 'bs', 'game, feature')})",
       f"qa AS ({grid_sql('gr', 'game, feature')}), qb AS ({grid_sql('bs', 'game, feature')})",
       body=f"""SELECT a.game, a.feature, round(k.ks, 6) AS ks, round({WD}, 6) AS wd FROM qa a JOIN qb b ON a.game = b.game AND a.feature = b.feature
       JOIN k ON k.game = a.game AND k.feature = a.feature"""))
def shift_per_game(spark, sf):
    """Every game against the training games, per feature."""
    f = session.cut(features(spark, sf))
    base = f.where(F.col("game").isin("g0", "g1"))
    return G.rounded(D.shift_table(f, ["game", "feature"], "value", base, ["feature"]).drop("n"), "ks", "wd")


YEARLY = f"""vals AS (SELECT year, 'raw' AS kind, value FROM lines UNION ALL SELECT year, 'robust', least(value, 12.0) FROM lines),
gr AS (SELECT year, kind, value FROM vals WHERE year > {A.BASE_YEAR}),
bs AS (SELECT y.year, kind, value FROM vals v, (SELECT DISTINCT year FROM vals WHERE year > {A.BASE_YEAR}) y WHERE v.year = {A.BASE_YEAR})"""


@query("dst04_yearly_raw_robust", with_tables(A.LINES, YEARLY, f"k AS ({ks_sql('gr', 'bs', 'year, kind')})",
       f"qa AS ({grid_sql('gr', 'year, kind')}), qb AS ({grid_sql('bs', 'year, kind')})",
       body=f"SELECT a.year, a.kind, round(k.ks, 6) AS ks, round({WD}, 6) AS wd FROM qa a JOIN qb b ON a.year = b.year AND a.kind = b.kind JOIN k ON k.year = a.year AND k.kind = a.kind"))
def yearly_raw_robust(spark, sf):
    lines = D.melt_features(A.lines(spark, sf), ["year"], {"raw": F.col("value"), "robust": F.least("value", F.lit(12.0))}).withColumnRenamed("feature", "kind")
    base = lines.where(F.col("year") == A.BASE_YEAR)
    return G.rounded(D.shift_table(lines.where(F.col("year") > A.BASE_YEAR), ["year", "kind"], "value", base, ["kind"]).drop("n"), "ks", "wd")


WINDOWS = """tr AS (SELECT game, robot_id, CAST((row_number() OVER (PARTITION BY game ORDER BY min(t), robot_id) - 1) // 8 AS INTEGER) AS window_id FROM detections GROUP BY game, robot_id),
gr AS (SELECT f.game || '/' || window_id AS w, f.game, window_id, feature, value FROM feats f JOIN tr ON tr.game = f.game AND tr.robot_id = f.robot_id),
bs AS (SELECT g.w, feature, value FROM feats f, (SELECT DISTINCT w FROM gr) g WHERE f.game IN ('g0', 'g1')),
ids AS (SELECT w, game, window_id, count(DISTINCT feature) AS z FROM gr GROUP BY ALL)"""


def window_features(spark, sf):
    """Features with the number of the track window they fall in."""
    from tidemark.operators.smoothers import interleaved

    order = interleaved(A.detections(spark, sf), "game", ["team", "robot_id"], "t")
    order = order.drop("place", "n", "team")
    tracks = G.game_chunks(order, "game", ["t0", "robot_id"], 8).select("game", "robot_id", "window_id")
    return features(spark, sf).join(J.small(tracks), ["game", "robot_id"])


WINDOW_BODY = f"""SELECT i.game, i.window_id, a.feature, round(k.ks, 6) AS ks, round({WD}, 6) AS wd FROM qa a JOIN qb b ON a.w = b.w AND a.feature = b.feature
JOIN k ON k.w = a.w AND k.feature = a.feature JOIN ids i ON i.w = a.w"""


@query("dst05_shift_per_window", with_tables(*TRACKED, WINDOWS, f"k AS ({ks_sql('gr', 'bs', 'w, feature')})",
       f"qa AS ({grid_sql('gr', 'w, feature')}), qb AS ({grid_sql('bs', 'w, feature')})", body=WINDOW_BODY))
def shift_per_window(spark, sf):
    f = session.cut(window_features(spark, sf))
    base = f.where(F.col("game").isin("g0", "g1"))
    return G.rounded(D.shift_table(f, ["game", "window_id", "feature"], "value", base, ["feature"]).drop("n"), "ks", "wd")


@query("dst06_window_spread", with_tables(*TRACKED, WINDOWS, f"k AS ({ks_sql('gr', 'bs', 'w, feature')})", body="""
SELECT i.game, k.feature, round(quantile_cont(ks, 0.5), 6) AS p50, round(quantile_cont(ks, 0.9), 6) AS p90 FROM k JOIN ids i ON i.w = k.w GROUP BY i.game, k.feature"""))
def window_spread(spark, sf):
    f = session.cut(window_features(spark, sf))
    base = f.where(F.col("game").isin("g0", "g1"))
    ks = D.ks_against(f, ["game", "window_id", "feature"], "value", base, ["feature"])
    q = exact_quantiles(ks, ["game", "feature"], "ks", [0.5, 0.9])
    return G.rounded(q.select("game", "feature", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90")), "p50", "p90")


@query("dst07_ks_critical", with_tables(A.ERRORS, f"""
e AS (SELECT year, ade_traj FROM errors), base AS (SELECT ade_traj FROM e WHERE year = {A.BASE_YEAR}),
v AS (SELECT y.year, x.ade_traj AS v FROM (SELECT DISTINCT year FROM e WHERE year > {A.BASE_YEAR}) y, (SELECT DISTINCT ade_traj FROM e) x),
one AS (SELECT year, ade_traj AS v, count(*) AS c FROM e GROUP BY year, ade_traj), zero AS (SELECT ade_traj AS v, count(*) AS c FROM base GROUP BY ade_traj),
cum AS (SELECT v.year, sum(coalesce(one.c, 0)) OVER w AS a, sum(coalesce(zero.c, 0)) OVER w AS b
        FROM v LEFT JOIN one ON one.year = v.year AND one.v = v.v LEFT JOIN zero ON zero.v = v.v WINDOW w AS (PARTITION BY v.year ORDER BY v.v)),
ks AS (SELECT year, max(abs(a / n - b / m)) AS ks, any_value(n) AS n, any_value(m) AS m
       FROM cum JOIN (SELECT year, count(*)::DOUBLE AS n FROM e GROUP BY year) USING (year), (SELECT count(*)::DOUBLE AS m FROM base) GROUP BY year)""", body="""
SELECT year, round(ks, 6) AS ks, round(sqrt(-ln(0.025) / 2 * (n + m) / (n * m)), 9) AS critical, ks >= sqrt(-ln(0.025) / 2 * (n + m) / (n * m)) AS drift FROM ks"""))
def ks_critical(spark, sf):
    """Is the distance of each year to the base year beyond the critical value for all rows of both?"""
    e = A.errors(spark, sf)
    sizes = e.groupBy("year").agg(F.count(F.lit(1)).cast("double").alias("rows_of_year"))
    m = e.where(F.col("year") == A.BASE_YEAR).count()
    ks = D.ks_against(e.where(F.col("year") > A.BASE_YEAR), ["year"], "ade_traj", e.where(F.col("year") == A.BASE_YEAR)).join(sizes, "year")
    limit = F.sqrt(-F.log(F.lit(0.025)) / 2 * (F.col("rows_of_year") + float(m)) / (F.col("rows_of_year") * float(m)))
    return G.rounded(ks.select("year", "ks", F.round(limit, 9).alias("critical"), (F.col("ks") >= limit).alias("drift")), "ks")


KS_SIDES = """rows AS (SELECT match_id AS part, CAST(floor(ade_traj * 10) AS BIGINT) AS v, model = '1-URGENT' AS a FROM errors WHERE model IN ('1-URGENT', '5-LOW')
  UNION ALL SELECT 'all_' || CAST(year AS VARCHAR), CAST(floor(ade_traj * 10) AS BIGINT), model = '1-URGENT' FROM errors WHERE model IN ('1-URGENT', '5-LOW')),
counts AS (SELECT part, v, CAST(count(*) FILTER (a) AS BIGINT) AS a, CAST(count(*) FILTER (NOT a) AS BIGINT) AS b FROM rows GROUP BY part, v),
cum AS (SELECT part, CAST(sum(a) OVER w AS BIGINT) AS ca, CAST(sum(b) OVER w AS BIGINT) AS cb, CAST(sum(a) OVER p AS BIGINT) AS n, CAST(sum(b) OVER p AS BIGINT) AS m
  FROM counts WINDOW w AS (PARTITION BY part ORDER BY v), p AS (PARTITION BY part)),
found AS (SELECT part, n, m, max(abs(ca * m - cb * n)) AS gap, max(abs(ca * m - cb * n)) / sqrt(n::DOUBLE * m * (n + m)) AS z FROM cum WHERE n * m > 0 GROUP BY part, n, m)"""


@query("dst07_ks_p_values", with_tables(A.ERRORS, KS_SIDES, f"""
walk AS (SELECT part, 0::BIGINT AS t, 0::BIGINT AS i, 1.0::DOUBLE AS q, 0.0::DOUBLE AS hit FROM found WHERE n * m <= {D.KS_EXACT}
  UNION ALL
  SELECT part, t, i, CASE WHEN far THEN 0 ELSE q END, CASE WHEN far THEN q ELSE 0 END FROM (
    SELECT s.part, s.t, s.i, s.q, e.part IS NOT NULL AND abs(s.i * f.m - (s.t - s.i) * f.n) >= f.gap AS far
    FROM (SELECT part, t + 1 AS t, i + step AS i, sum(q * CASE WHEN step = 1 THEN n - i ELSE m - (t - i) END / (n + m - t)) AS q
          FROM walk JOIN found USING (part), (VALUES (0::BIGINT), (1::BIGINT)) u(step)
          WHERE t < n + m AND q > 0 AND CASE WHEN step = 1 THEN i < n ELSE t - i < m END GROUP BY part, t + 1, i + step) s
    JOIN found f ON f.part = s.part LEFT JOIN cum e ON e.part = s.part AND e.ca + e.cb = s.t)),
counted AS (SELECT part, least(sum(hit), 1) AS p FROM walk GROUP BY part)""", recursive=True, body=f"""
SELECT part, n AS n_a, m AS n_b, round(gap / (n::DOUBLE * m), 9) AS ks, n * m <= {D.KS_EXACT} AS counted,
       round(coalesce(p, CASE WHEN z < {D.KS_NEAR_ZERO} THEN 1 ELSE greatest(least(
         list_sum(list_transform(range(1, {D.KS_TERMS + 1}), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * z * z))), 1), 0) END)::DOUBLE, 9) AS p
FROM found LEFT JOIN counted USING (part)"""))
def ks_p_values(spark, sf):
    """Do the errors of two models, in tenths and so with ties, differ in each game and in each year?"""
    e = A.errors(spark, sf).where(F.col("model").isin("1-URGENT", "5-LOW"))
    part = F.explode(F.array("match_id", F.concat(F.lit("all_"), F.col("year").cast("string"))))
    rows = e.select(part.alias("part"), F.floor(F.col("ade_traj") * 10).alias("v"), "model")
    out = D.ks_p_values(rows, ["part"], "v", F.col("model") == "1-URGENT")
    counted = (F.col("n_a") * F.col("n_b") <= D.KS_EXACT).alias("counted")
    return out.select("part", "n_a", "n_b", F.round("ks", 9).alias("ks"), counted, F.round("p", 9).alias("p"))


TRACK_W = """p AS (SELECT robot_id, game, pos, x, y, vx, vy, row_number() OVER (PARTITION BY robot_id ORDER BY pos) - 1 AS start, count(*) OVER (PARTITION BY robot_id) AS n FROM steps),
w0 AS (SELECT robot_id, game, start, n, list(x) OVER f AS x, list(y) OVER f AS y, list(vx) OVER f AS vx, list(vy) OVER f AS vy FROM p
  WINDOW f AS (PARTITION BY robot_id ORDER BY start ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
win AS (SELECT * FROM w0 WHERE start < n - 9 AND list_avg(list_transform(range(7, 10), lambda i: sqrt(vx[i] * vx[i] + vy[i] * vy[i]))) >= 5),
kin AS (SELECT robot_id, start, list_transform(range(1, 7), lambda i: sqrt(vx[i] * vx[i] + vy[i] * vy[i])) AS speed,
  list_transform(range(1, 6), lambda i: sqrt(pow(vx[i + 1] - vx[i], 2) + pow(vy[i + 1] - vy[i], 2))) AS accel,
  list_transform([1, 2, 3, 4, 5, 5], lambda i: abs(atan2(vy[i + 1], vx[i + 1]) - atan2(vy[i], vx[i]))) AS turn FROM win)"""
TRACK_CTES = (A.DETECTIONS, A.STEPS, TRACK_W)


def windows(spark, sf):
    # stored, because the length of the longest track and the windows are two jobs
    return T.forecast_windows(session.cut(A.steps(spark, sf)), ["robot_id"], ["pos"], 6, 3, 5.0, ["game"])


CLIPS = """c AS (SELECT (SELECT quantile_cont(v, 0.995) FROM (SELECT unnest(speed) AS v FROM kin)) AS cs, (SELECT quantile_cont(v, 0.995) FROM (SELECT unnest(accel) AS v FROM kin)) AS ca,
  (SELECT quantile_cont(v, 0.995) FROM (SELECT unnest(turn) AS v FROM kin)) AS ct),
kc AS (SELECT robot_id, start, list_transform(speed, lambda v: least(v, cs)) AS s, list_transform(accel, lambda v: least(v, ca)) AS a, list_transform(turn, lambda v: least(v, ct)) AS t FROM kin, c)"""
NAMES = ["speed_mean", "speed_p90", "speed_p99", "accel_mean", "accel_p90", "accel_p99", "turn_mean", "turn_p90"]


def feature_vectors(spark, sf, w=None):
    """Eight log-scaled features per window, arrays capped at the pooled p99.5.

    The arrays are stored: each of the three bounds reads them twice, the features once more.
    """
    w = windows(spark, sf) if w is None else w
    arrays = scalars.kinematic_features(F.col("past_vx"), F.col("past_vy"))
    k = session.cut(w.select("robot_id", "start", "game", *[a.alias(n) for n, a in arrays.items()]))
    caps = {n: exact_quantiles(k.select(F.explode(n).alias("v")), [], "v", [0.995]).select(F.col("q")[0]).scalar() for n in arrays}
    k = k.withColumns({f"_{n}": c for n, c in caps.items()})
    capped = {n: F.transform(n, _cap(n)) for n in arrays}
    return k.select("robot_id", "start", "game", *[c.alias(n) for n, c in scalars.kinematic_summary(capped).items()])


def _cap(name):
    return lambda v: F.least(v, F.col(f"_{name}"))


@query("dst08_feature_vector", with_tables(*TRACK_CTES, CLIPS, body="SELECT robot_id, start, " + ", ".join([
    "round(ln(1 + list_avg(s)), 6) AS speed_mean", "round(ln(1 + list_aggregate(s, 'quantile_cont', 0.9)), 6) AS speed_p90", "round(ln(1 + list_aggregate(s, 'quantile_cont', 0.99)), 6) AS speed_p99",
    "round(ln(1 + list_avg(a)), 6) AS accel_mean", "round(ln(1 + list_aggregate(a, 'quantile_cont', 0.9)), 6) AS accel_p90", "round(ln(1 + list_aggregate(a, 'quantile_cont', 0.99)), 6) AS accel_p99",
    "round(ln(1 + list_avg(t)), 6) AS turn_mean", "round(ln(1 + list_aggregate(t, 'quantile_cont', 0.9)), 6) AS turn_p90"]) + " FROM kc"))
def feature_vector(spark, sf):
    return G.rounded(feature_vectors(spark, sf).drop("game"), *NAMES)


@query("dst09_window_features", with_tables(*TRACK_CTES, body="""
SELECT robot_id, start, round(list_aggregate(accel, 'quantile_cont', 0.95), 6) AS accel_p95, round(list_avg(accel), 6) AS accel_mean,
       round(list_aggregate(speed, 'quantile_cont', 0.95), 6) AS speed_p95, round(list_avg(speed), 6) AS speed_mean FROM kin"""))
def window_summary(spark, sf):
    a = scalars.kinematic_features(F.col("past_vx"), F.col("past_vy"))
    return windows(spark, sf).select(
        "robot_id", "start", *[F.round(c, 6).alias(n) for n, c in {
            "accel_p95": scalars.array_quantile(a["accel"], 0.95), "accel_mean": scalars.array_mean(a["accel"]),
            "speed_p95": scalars.array_quantile(a["speed"], 0.95), "speed_mean": scalars.array_mean(a["speed"])}.items()])


@query("dst11_median_distance", f"""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
s AS (SELECT * FROM e ORDER BY {row_hash_sql('vec_id', "'42'")}, vec_id LIMIT 400),
d AS (SELECT sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2)) AS d FROM s x JOIN s y ON x.vec_id < y.vec_id)
SELECT (SELECT count(*) FROM s) AS n, round(quantile_cont(d, 0.5), 5) AS sigma FROM d WHERE d > 0""")
def median_distance(spark, sf):
    e = A.table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("abc")])
    sigma = D.median_distance(e, list("abc"), "vec_id", most=400)
    n = M.hash_cap(e.select("vec_id"), [], "vec_id", 400)
    return n.agg(F.count(F.lit(1)).alias("n")).withColumn("sigma", F.round(F.lit(sigma), 5))


# ---- tracks ------------------------------------------------------------------------

COMMANDS = """cmds AS (SELECT robot_id, t, frame, CASE kind WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 0 END AS command FROM detections WHERE kind IN ('purchase', 'signup', 'error')),
dets AS (SELECT robot_id, t, frame, x, y FROM detections WHERE kind IN ('view', 'click'))"""


def commands(spark, sf):
    d = A.detections(spark, sf).where(F.col("kind").isin("purchase", "signup", "error"))
    return d.select("robot_id", "t", "frame", F.when(F.col("kind") == "purchase", 2).when(F.col("kind") == "signup", 3).otherwise(0).alias("command"))


def plays(spark, sf):
    d = A.detections(spark, sf).where(F.col("kind").isin("view", "click")).select("robot_id", "t", "frame", "x", "y")
    return T.play_segments(d, commands(spark, sf), ["robot_id"], "t", "frame")


SEGMENTS = """st AS (SELECT robot_id, t, frame, command IN (2, 3) AS is_open, coalesce(lag(command IN (2, 3)) OVER (PARTITION BY robot_id ORDER BY t, frame), false) AS was FROM cmds),
ax AS (SELECT robot_id, t, frame, NULL::DOUBLE AS x, CASE WHEN is_open <> was THEN CASE WHEN is_open THEN 1 ELSE 0 END END AS mark, 0 AS turn FROM st
       UNION ALL SELECT robot_id, t, frame, x, NULL, 1 FROM dets),
sg AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS active, count(*) FILTER (mark = 0) OVER w AS stop_id FROM ax WINDOW w AS (PARTITION BY robot_id ORDER BY t, turn, frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("trk01_play_segments", with_tables(A.DETECTIONS, COMMANDS, SEGMENTS, body="SELECT robot_id, frame, stop_id FROM sg WHERE turn = 1 AND active = 1"))
def play_segments(spark, sf):
    return plays(spark, sf).select("robot_id", "frame", "stop_id")


@query("trk02_one_per_frame", with_tables(A.DETECTIONS, body="""
SELECT robot_id, frame // 40 AS frame, arg_min(x, frame) AS x, min(frame) AS place FROM detections GROUP BY robot_id, frame // 40"""))
def one_per_frame(spark, sf):
    d = A.detections(spark, sf).select("robot_id", F.floor(F.col("frame") / 40).alias("frame"), F.col("frame").alias("place"), "x")
    return T.one_per_frame(d, ["robot_id", "frame"], ["place"])


@query("trk03_gap_fill", with_tables(A.DETECTIONS, """
s0 AS (SELECT robot_id, t / 1200000 AS t, x, row_number() OVER (PARTITION BY robot_id ORDER BY t) AS n FROM detections),
ch AS (SELECT robot_id, n, t, x, t AS last, true AS keep FROM s0 WHERE n = 1
       UNION ALL SELECT s0.robot_id, s0.n, s0.t, s0.x, CASE WHEN s0.t - last > 0.01 THEN s0.t ELSE last END, s0.t - last > 0.01
       FROM ch JOIN s0 ON s0.robot_id = ch.robot_id AND s0.n = ch.n + 1),
s AS (SELECT robot_id, t, x FROM ch WHERE keep), g AS (SELECT *, lead(t) OVER (PARTITION BY robot_id ORDER BY t) - t AS gap FROM s),
k AS (SELECT *, CASE WHEN gap >= 0.022 THEN greatest(CAST(floor(60 * gap - 0.6) AS INTEGER), 0) ELSE 0 END AS n FROM g)""", body="""
SELECT robot_id, sum(n)::BIGINT AS filled, count(*) AS seen, round(sum(x * (n + 1)), 4) AS held FROM k GROUP BY robot_id""", recursive=True))
def gap_fill(spark, sf):
    """Time is scaled down so that gaps lie around the frame rate."""
    d = A.detections(spark, sf).select("robot_id", (F.col("t") / 1200000).alias("t"), "x")
    f = T.fill_gaps(d, ["robot_id"], "t", ["x"])
    return f.groupBy("robot_id").agg(F.count_if(~F.col("mask")).alias("filled"), F.count_if(F.col("mask")).alias("seen"), F.round(F.sum("x"), 4).alias("held"))


@query("trk04_smoothed_tracks")
def smoothed_tracks(spark, sf):
    d = A.detections(spark, sf).select("robot_id", "t", "x", "y", (F.col("y") / 20).alias("psi"), (F.col("frame") % 9 != 0).alias("mask"))
    out = T.smooth_tracks(d, ["robot_id"], "t", process=1.0, sensor=0.5, shortest=40)
    return G.rounded(out.select("robot_id", "idx", "sx", "sy", "vx", "vy", "spsi"), "sx", "sy", "vx", "vy", "spsi", digits=4)


@query("trk05_track_kinematics", with_tables(*TRACKED, body="""
SELECT robot_id, feature, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM raw GROUP BY robot_id, feature"""))
def track_kinematics(spark, sf):
    f = features(spark, sf, clipped=False)
    q = exact_quantiles(f, ["robot_id", "feature"], "value", [0.5, 0.9])
    m = f.groupBy("robot_id", "feature").agg(F.avg("value").alias("mean"))
    out = q.join(m, ["robot_id", "feature"]).select("robot_id", "feature", "n", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"))
    return G.rounded(out, "mean", "p50", "p90")


@query("trk06_windows_with_targets", with_tables(*TRACK_CTES, body="""
SELECT robot_id, start, round(list_sum(list_transform([7, 8, 9], lambda i: (vx[i] - vx[i - 1]) / 25.0 * i)), 6) AS target_x,
  round(x[6] + list_sum(list_transform([7, 8, 9], lambda i: vx[i])), 6) AS end_x FROM win"""))
def windows_with_targets(spark, sf):
    """Increment targets, and the end position they integrate to."""
    stats = {"vx_std": 25.0, "vy_std": 25.0, "vx_avg": 0.0, "vy_avg": 0.0}
    w = T.targets(windows(spark, sf), stats)
    weighted = F.aggregate(F.transform("target_x", lambda v, i: v * (i + 7)), F.lit(0.0), lambda s, v: s + v)
    end = F.element_at(T.positions_from_targets(F.element_at("past_x", -1), F.element_at("past_vx", -1), F.col("target_x"), 25.0, 0.0, "dv"), -1)
    return w.select("robot_id", "start", F.round(weighted, 6).alias("target_x"), F.round(end, 6).alias("end_x"))


ERR = """err AS (SELECT robot_id, game, start, list_transform([7, 8, 9], lambda i: sqrt(pow(x[6] + (i - 6) * vx[6] - x[i], 2) + pow(y[6] + (i - 6) * vy[6] - y[i], 2))) AS d FROM win)"""


@query("trk07_error_table", with_tables(*TRACK_CTES, ERR, body="""
SELECT robot_id, start, round(list_avg(d), 6) AS ade_traj, round(d[3], 6) AS fde_traj, 'constant' AS model, '6->3' AS horizon, CAST(3 AS INTEGER) AS n_steps_pred FROM err"""))
def error_table(spark, sf):
    out = T.error_rows(windows(spark, sf), 3, ["robot_id", "start"], "constant", "6->3")
    return G.rounded(out, "ade_traj", "fde_traj")


@query("trk07_forecast_errors", with_tables(*TRACK_CTES, body="""
SELECT robot_id, start, 'last' AS model, '6->3' AS horizon, CAST(3 AS INTEGER) AS n_steps_pred,
  round(list_avg(list_transform([7, 8, 9], lambda i: sqrt(pow(x[6] - x[i], 2) + pow(y[6] - y[i], 2)))), 6) AS ade_traj, round(sqrt(pow(x[6] - x[9], 2) + pow(y[6] - y[9], 2)), 6) AS fde_traj FROM win"""))
def forecast_errors(spark, sf):
    """A forecast table from elsewhere: the last position repeated."""
    w = windows(spark, sf)
    f = w.select("robot_id", "start", F.lit("last").alias("model"), F.lit("6->3").alias("horizon"),
                 *[F.array_repeat(F.element_at(f"past_{c}", -1), 3).alias(f"pred_{c}") for c in "xy"])
    return G.rounded(T.errors_of_forecasts(w, f, ["robot_id", "start"]), "ade_traj", "fde_traj")


@query("trk08_adaptation_set", with_tables(A.ERRORS, "q AS (SELECT quantile_cont(ade_traj, 0.7) AS cut FROM errors WHERE year >= 1998)", f"""
rp AS (SELECT traj_id, row_number() OVER (PARTITION BY year ORDER BY {row_hash_sql('traj_id', "'7'")}, traj_id) AS k FROM errors WHERE year < 1998)""", body="""
SELECT 'target' AS part, traj_id FROM errors, q WHERE year >= 1998 AND ade_traj >= cut UNION ALL SELECT 'replay', traj_id FROM rp WHERE k <= 150"""))
def adaptation_set(spark, sf):
    """The hardest rows of the new regime plus a uniform replay of the old one."""
    e = A.errors(spark, sf)
    new = e.where("year >= 1998")
    cut = exact_quantiles(new, [], "ade_traj", [0.7]).select(F.col("q")[0]).scalar()
    target = new.where(F.col("ade_traj") >= cut).select(F.lit("target").alias("part"), "traj_id")
    replay = M.hash_cap(e.where("year < 1998"), ["year"], "traj_id", 150, 7).select(F.lit("replay").alias("part"), "traj_id")
    return target.unionByName(replay)


@query("dst17_weight_caps", with_tables(A.ERRORS, A.WEIGHTED, f"""
caps AS (SELECT unnest([1.5, 2.0, 3.0, 1e9])::DOUBLE AS cap), b AS (SELECT avg(ade_traj) AS base FROM weighted WHERE year = {A.BASE_YEAR}),
m AS (SELECT year, cap, avg(ade_traj) AS a, sum(least(w, cap) * ade_traj) / sum(least(w, cap)) AS iw, sum(least(w, cap)) AS s1, sum(least(w, cap) * least(w, cap)) AS s2, count(*) AS n
      FROM weighted, caps WHERE year > {A.BASE_YEAR} GROUP BY year, cap)""", body="""
SELECT year, cap, round(CASE WHEN a - base > 1e-6 THEN (a - iw) / (a - base) * 100 END, 4) AS recovery_pct, round(s1 * s1 / (n * s2), 6) AS ess FROM m, b"""))
def weight_caps(spark, sf):
    w = A.weighted(spark, sf)
    base = w.where(F.col("year") == A.BASE_YEAR).agg(F.avg("ade_traj")).scalar()
    x = w.where(F.col("year") > A.BASE_YEAR).withColumn("cap", F.explode(F.array(*[F.lit(c) for c in (1.5, 2.0, 3.0, 1e9)])))
    c = F.least("w", "cap")
    m = x.groupBy("year", "cap").agg(
        F.avg("ade_traj").alias("a"), (F.sum(c * F.col("ade_traj")) / F.sum(c)).alias("iw"),
        (F.sum(c) * F.sum(c) / (F.count(F.lit(1)) * F.sum(c * c))).alias("ess")).withColumn("_b", base)
    rec = F.when(F.col("a") - F.col("_b") > 1e-6, (F.col("a") - F.col("iw")) / (F.col("a") - F.col("_b")) * 100)
    return m.select("year", "cap", F.round(rec, 4).alias("recovery_pct"), F.round("ess", 6).alias("ess"))


@query("dst19_division_validation", with_tables(A.ERRORS, A.GAMES, A.DIVISIONS, """
g AS (SELECT year, coalesce(division, 'Unknown') AS division, ade_mean FROM games LEFT JOIN divisions USING (proc_set_file) WHERE NOT (proc_set_file = 'g0' AND year = 1997))""", body="""
SELECT year, division, count(*) AS n_games, round(avg(ade_mean), 6) AS ade_mean, count(*) < 2 AS insufficient FROM g GROUP BY year, division"""))
def division_validation(spark, sf):
    g = J.lookup(A.games(spark, sf).where("NOT (proc_set_file = 'g0' AND year = 1997)"), A.divisions(spark, sf), ["proc_set_file"], "division", "Unknown")
    out = g.groupBy("year", "division").agg(F.count(F.lit(1)).alias("n_games"), F.avg("ade_mean").alias("ade_mean"))
    return G.rounded(out.withColumn("insufficient", F.col("n_games") < 2), "ade_mean")


@query("dst19_division_intervals", with_tables(A.ERRORS, A.GAMES, A.DIVISIONS, f"""
g AS (SELECT year, coalesce(division, 'Unknown') AS division, ade_mean, year * 10 + CAST(substr(proc_set_file, 2) AS BIGINT) AS gid
      FROM games LEFT JOIN divisions USING (proc_set_file)),
k AS (SELECT g.*, rep, {poisson_sql(uniform_sql('gid', 'rep'))} AS k FROM g, (SELECT unnest(range(0, 2000)) AS rep)),
m AS (SELECT year, division, rep, sum(k * ade_mean) / nullif(sum(k), 0) AS m FROM k GROUP BY ALL),
q AS (SELECT year, division, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY ALL)""", body="""
SELECT g.year, g.division, round(avg(ade_mean), 6) AS mean, count(*) AS n, max(lo) AS lo, max(hi) AS hi
FROM g JOIN q ON q.year = g.year AND q.division = g.division GROUP BY g.year, g.division"""))
def division_intervals(spark, sf):
    """Mean error per year and division with a bootstrap interval over games."""
    g = J.lookup(A.games(spark, sf), A.divisions(spark, sf), ["proc_set_file"], "division", "Unknown")
    g = g.withColumn("gid", F.col("year") * 10 + F.substring("proc_set_file", 2, 9).cast("bigint"))
    return G.rounded(M.bootstrap_mean(g, ["year", "division"], "ade_mean", "gid", 2000), "mean", "lo", "hi")


@query("dst20_sample_size", with_tables(A.ERRORS, f"""
u AS (SELECT DISTINCT year, proc_set_file FROM errors),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY {row_hash_sql("(year || '_' || proc_set_file)", "'42'")}, proc_set_file) AS k FROM u),
a AS (SELECT e.year, avg(ade_traj) FILTER (k <= 3) AS m3, avg(ade_traj) AS m6 FROM errors e JOIN r USING (year, proc_set_file) GROUP BY e.year)""", body="""
SELECT year, round(m3, 6) AS m3, round(m6, 6) AS m6, round(abs(m6 - m3), 6) AS shift, abs(m6 - m3) > 0.05 AS flagged FROM a"""))
def sample_size(spark, sf):
    e = A.errors(spark, sf)
    three = M.stratified_units(e, "year", "proc_set_file", 3, [])
    m3 = e.join(J.small(three), ["year", "proc_set_file"], "left_semi").groupBy("year").agg(F.avg("ade_traj").alias("m3"))
    m6 = e.groupBy("year").agg(F.avg("ade_traj").alias("m6"))
    out = m3.join(m6, "year").withColumn("shift", F.abs(F.col("m6") - F.col("m3")))
    return G.rounded(out.withColumn("flagged", F.col("shift") > 0.05), "m3", "m6", "shift")
