"""Queries over sources, filters, projections, joins, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import metrics, scalars
from tidemark.operators import aggregates as G
from tidemark.operators import joins as J
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.sampling import hash_cap
from tidemark.functions.hashing import row_hash_sql
from tidemark.plans.catalog import query, with_tables
from tidemark.schema import GAME_METRICS, TRAJECTORY_ERRORS, finite, validate_schema
from tidemark.sources import adapters as A
from tidemark.sources import tables as S

YEARLY = "SELECT year, count(*) AS n, round(sum(ade_traj), 4) AS total FROM errors GROUP BY year"


def yearly(df):
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ade_traj"), 4).alias("total"))


# ---- sources and sinks --------------------------------------------------------

@query("src01_error_table_fallback", with_tables(A.ERRORS, body=YEARLY))
def error_table_fallback(spark, sf):
    """The table is only there as CSV, so the parquet read falls through."""
    base = session.shared_path(spark, "errors")
    S.write_table(validate_schema(A.errors(spark, sf), TRAJECTORY_ERRORS), f"{base}.csv", fmt="csv")
    return yearly(S.read_errors(spark, base))


@query("src02_column_pruning", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def column_pruning(spark, sf):
    return S.read_columns(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"]).where("o_totalprice > 400000")


@query("src03_csv_coercion", with_tables(A.ERRORS, body="""
SELECT CAST(year AS INTEGER) AS year, count(*) AS n, count(*) FILTER (traj_id % 10 <> 0) AS n_value,
       round(sum(ade_traj) FILTER (traj_id % 10 <> 0), 4) AS total FROM errors GROUP BY year"""))
def csv_coercion(spark, sf):
    """Text columns of a metrics CSV; one value in ten is not a number."""
    path = session.shared_path(spark, "metrics")
    text = A.errors(spark, sf).select(
        F.col("proc_set_file").alias("dataset"), "log_file", F.col("year").cast("string").alias("year"),
        F.lit("a vs b").alias("teams"), "model", F.lit("ADE").alias("metric"), "horizon",
        F.when(F.col("traj_id") % 10 == 0, "n/a").otherwise(F.col("ade_traj").cast("string")).alias("value"))
    S.write_table(text, path, fmt="csv")
    df = S.read_csv_numeric(spark, path, GAME_METRICS, {"year": "int", "value": "double"})
    return df.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"), F.round(F.sum("value"), 4).alias("total"))


@query("src04_first_lookup", with_tables(A.ERRORS, """
d AS (SELECT proc_set_file, arg_min(log_file, traj_id) AS log_file, arg_min(match_id, traj_id) AS match_id
      FROM errors GROUP BY proc_set_file)""", body="""
SELECT d.log_file, d.match_id AS first_match, count(*) AS n FROM errors e JOIN d USING (proc_set_file) GROUP BY ALL"""))
def first_lookup(spark, sf):
    e = A.errors(spark, sf)
    d = S.first_lookup(e, ["proc_set_file"], ["traj_id"], ["log_file", "match_id"])
    return e.select("proc_set_file").join(J.small(d), "proc_set_file").groupBy(
        "log_file", F.col("match_id").alias("first_match")).agg(F.count(F.lit(1)).alias("n"))


@query("src05_stacked_files", with_tables(A.ERRORS, body="""
SELECT CASE WHEN year < 1998 THEN 'A' ELSE 'B' END AS fold, model, count(*) AS n FROM errors GROUP BY ALL"""))
def stacked_files(spark, sf):
    """Two partial results; the older file has no fold column."""
    base = session.shared_path(spark, "grid")
    e = A.errors(spark, sf)
    S.write_table(e.where("year < 1998").select("model", "traj_id"), f"{base}/grid_a")
    S.write_table(e.where("year >= 1998").select("model", "traj_id").withColumn("fold", F.lit("B")), f"{base}/grid_b")
    df = S.read_many(spark, [f"{base}/grid_a", f"{base}/grid_b", f"{base}/grid_c"], {"fold": "A"})
    return df.groupBy("fold", "model").agg(F.count(F.lit(1)).alias("n"))


CAP_SQL = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {row_hash_sql('row_id', "'42'")}, row_id) AS k FROM stacked)"""


@query("src06_capped_inputs", "WITH stacked AS (SELECT 'orders' AS src, o_orderkey AS row_id FROM orders UNION ALL "
       "SELECT 'events', event_id FROM events)," + CAP_SQL + " SELECT src, row_id FROM ranked WHERE k <= 300")
def capped_inputs(spark, sf):
    base = session.shared_path(spark, "inputs")
    for name, key in (("orders", "o_orderkey"), ("events", "event_id")):
        S.write_table(A.table(spark, sf, name).select(F.col(key).alias("row_id")), f"{base}/{name}")
    paths = {n: f"{base}/{n}" for n in ("orders", "events", "absent")}
    return S.load_inputs(spark, paths, "src", "row_id", cap=300)


@query("src07_partitioned_sink", with_tables(A.ERRORS, body=YEARLY))
def partitioned_sink(spark, sf):
    path = session.shared_path(spark, "sink")
    S.write_table(A.errors(spark, sf), path, ["model", "year"])
    return yearly(spark.read.parquet(path)).withColumn("year", F.col("year").cast("int"))


@query("src07_feature_cache", with_tables(A.DETECTIONS, A.STEPS, body="""
SELECT robot_id, round(avg(sqrt(vx * vx + vy * vy)), 6) AS speed_mean FROM steps GROUP BY robot_id"""))
def feature_cache(spark, sf):
    path = session.shared_path(spark, "features")
    build = lambda: A.steps(spark, sf).groupBy("robot_id").agg(F.avg(F.hypot("vx", "vy")).alias("speed_mean"))
    S.cached_features(spark, path, build)
    return G.rounded(S.cached_features(spark, path, build), "speed_mean")


@query("src08_track_table", with_tables(A.DETECTIONS, body="""
SELECT robot_id, count(*) AS n, round(sum(x), 4) AS sx, round(max(t), 3) AS t_end FROM detections GROUP BY robot_id"""))
def track_table(spark, sf):
    path = session.shared_path(spark, "tracks")
    S.write_tracks(A.detections(spark, sf), path, ["robot_id"], ["t", "frame"], ["x", "y"])
    return spark.read.parquet(path).groupBy("robot_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.max("t"), 3).alias("t_end"))


@query("src09_quality_report", with_tables(A.ERRORS, body="""
SELECT year, count(*) AS n_rows, count(*) FILTER (ade_traj IS NULL OR NOT isfinite(ade_traj)) AS bad_ade_traj,
       count(DISTINCT proc_set_file) AS n_games, count(DISTINCT proc_set_file) < 2 AS few_games FROM errors GROUP BY year"""))
def quality_report(spark, sf):
    games = F.count_distinct("proc_set_file")
    return S.quality_report(A.errors(spark, sf), ["year"], ["ade_traj"], {"n_games": games, "few_games": games < 2})


@query("src09_expected_inputs", with_tables(A.ERRORS, body="""
SELECT 'g' || n_nationkey AS proc_set_file, n_nationkey < 6 AS present FROM nation"""))
def expected_inputs(spark, sf):
    want = A.table(spark, sf, "nation").select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("proc_set_file"))
    return S.expected_inputs(want, A.errors(spark, sf), ["proc_set_file"])


@query("src10_ordered_stream", with_tables(A.ERRORS, A.STREAM, body="SELECT model, idx, traj_id, year FROM stream"))
def ordered_stream(spark, sf):
    return A.stream(spark, sf).df.select("model", "idx", "traj_id", "year")


# ---- filters and projections ----------------------------------------------------

@query("flt01_equality", with_tables(A.ERRORS, body="SELECT traj_id, ade_traj FROM errors WHERE model = '2-HIGH' AND horizon = '30->15' AND year = 1997"))
def equality(spark, sf):
    return A.errors(spark, sf).where(
        (F.col("model") == "2-HIGH") & (F.col("horizon") == A.HORIZON) & (F.col("year") == 1997)).select("traj_id", "ade_traj")


@query("flt02_membership", with_tables(A.ERRORS, body="""
SELECT model, count(*) AS n FROM errors WHERE horizon IN ('30->15', '30→15') AND model NOT IN ('5-LOW') GROUP BY model"""))
def membership(spark, sf):
    return A.errors(spark, sf).where(
        F.col("horizon").isin("30->15", "30→15") & ~F.col("model").isin("5-LOW")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("flt03_finite_only", """SELECT CAST(o_orderkey % 7 AS BIGINT) AS k, count(*) AS n, round(avg(o_totalprice), 4) AS mean
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 GROUP BY 1""")
def finite_only(spark, sf):
    """NULL, NaN and infinite readings are left out before any statistic."""
    o = A.table(spark, sf, "orders")
    v = (F.when(F.col("o_orderkey") % 11 == 0, F.lit(float("nan")))
         .when(F.col("o_orderkey") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice")))
    return o.withColumn("v", v).where(finite("v")).groupBy((F.col("o_orderkey") % 7).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query("flt04_minimum_motion", with_tables(A.DETECTIONS, A.STEPS, body="""
SELECT robot_id, count(*) AS n, round(avg(sqrt(vx * vx + vy * vy)), 6) AS speed FROM steps
GROUP BY robot_id HAVING count(*) > 50 AND avg(sqrt(vx * vx + vy * vy)) >= 60"""))
def minimum_motion(spark, sf):
    t = A.steps(spark, sf).groupBy("robot_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.hypot("vx", "vy")).alias("speed"))
    return G.rounded(t.where("n > 50 AND speed >= 60"), "speed")


@query("flt05_excluded_periods", with_tables(A.ERRORS, body="""
SELECT year, count(*) AS n FROM errors WHERE year NOT IN (1996, 1999) AND proc_set_file NOT IN ('g1', 'g2') GROUP BY year"""))
def excluded_periods(spark, sf):
    return A.errors(spark, sf).where(
        ~F.col("year").isin(1996, 1999) & ~F.col("proc_set_file").isin("g1", "g2")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("flt06_admissible_or_all", with_tables(A.ERRORS, A.GAMES, """
f AS (SELECT *, max(CASE WHEN ade_mean <= 4.6 THEN 1 ELSE 0 END) OVER (PARTITION BY year) AS ok FROM games)""", body="""
SELECT year, proc_set_file, n_traj FROM f WHERE ok = 0 OR ade_mean <= 4.6"""))
def admissible_or_all(spark, sf):
    return J.admissible_or_all(A.games(spark, sf), ["year"], F.col("ade_mean") <= 4.6).select("year", "proc_set_file", "n_traj")


@query("flt07_text_predicates", """SELECT p_type, count(*) AS n FROM part
WHERE starts_with(p_name, 'blue') OR contains(p_name, 'ring') GROUP BY p_type""")
def text_predicates(spark, sf):
    return A.table(spark, sf, "part").where(F.startswith(F.col("p_name"), F.lit("blue")) | F.contains(F.col("p_name"), F.lit("ring"))).groupBy(
        "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("flt08_top_fraction", with_tables(A.ERRORS, "q AS (SELECT quantile_cont(ade_traj, 0.75) AS cut FROM errors)",
       body="SELECT traj_id, ade_traj FROM errors, q WHERE ade_traj >= cut"))
def top_fraction(spark, sf):
    e = A.errors(spark, sf)
    cut = exact_quantiles(e, [], "ade_traj", [0.75]).select(F.col("q")[0]).scalar()
    return e.where(F.col("ade_traj") >= cut).select("traj_id", "ade_traj")


@query("prj01_feature_caps", """SELECT CASE WHEN event_type = 'view' THEN 'speed' WHEN event_type = 'click' THEN 'accel' ELSE 'turn' END AS feature,
  round(sum(CASE WHEN event_type = 'view' THEN least(value * 100, 8000.0) WHEN event_type = 'click' THEN least(value * 100, 500.0)
  ELSE value * 100 END), 4) AS total FROM events GROUP BY 1""")
def feature_caps(spark, sf):
    e = A.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "view", "speed").when(F.col("event_type") == "click", "accel").otherwise("turn").alias("feature"),
        (F.col("value") * 100).alias("v"))
    return e.groupBy("feature").agg(F.round(F.sum(scalars.robust_clip(F.col("feature"), F.col("v"))), 4).alias("total"))


@query("prj02_quantile_clip", with_tables(A.LINES, "q AS (SELECT quantile_cont(value, 0.995) AS hi FROM lines)", body="""
SELECT model, round(max(least(greatest(value, 0), hi)), 6) AS top, round(avg(least(greatest(value, 0), hi)), 6) AS mean
FROM lines, q GROUP BY model"""))
def quantile_clip(spark, sf):
    lines = A.lines(spark, sf)
    hi = exact_quantiles(lines, [], "value", [0.995]).select(F.col("q")[0]).scalar()
    clipped = lines.withColumn("c", F.least(F.greatest("value", F.lit(0.0)), hi))
    return G.rounded(clipped.groupBy("model").agg(F.max("c").alias("top"), F.avg("c").alias("mean")), "top", "mean")


@query("prj03_aligned_columns", with_tables(A.ERRORS, A.GAMES, body="""
SELECT proc_set_file AS detector, n_traj AS n_alarms, CAST(NULL AS VARCHAR) AS config FROM games"""))
def aligned_columns(spark, sf):
    g = A.games(spark, sf).withColumnsRenamed({"proc_set_file": "detector", "n_traj": "n_alarms"})
    want = {"detector": "string", "n_alarms": "bigint", "config": "string"}
    return g.select(*[(F.col(c) if c in g.columns else F.lit(None)).cast(t).alias(c) for c, t in want.items()])


LABELS = {"1-URGENT": "primary", "2-HIGH": "secondary", "5-LOW": "watch"}


@query("prj04_mapped_labels", with_tables(A.ERRORS, body="""
SELECT CASE model WHEN '1-URGENT' THEN 'primary' WHEN '2-HIGH' THEN 'secondary' WHEN '5-LOW' THEN 'watch' ELSE 'none' END AS role,
       count(*) AS n FROM errors GROUP BY 1"""))
def mapped_labels(spark, sf):
    pairs = F.create_map(*[F.lit(v) for kv in LABELS.items() for v in kv])
    return A.errors(spark, sf).groupBy(F.coalesce(F.try_element_at(pairs, F.col("model")), F.lit("none")).alias("role")).agg(
        F.count(F.lit(1)).alias("n"))


@query("prj05_rounded_report", with_tables(A.ERRORS, A.GAMES, body="""
SELECT year, proc_set_file, round(ade_mean, 2) AS ade2, round(ade_mean, 4) AS ade4 FROM games"""))
def rounded_report(spark, sf):
    return A.games(spark, sf).select("year", "proc_set_file", F.round("ade_mean", 2).alias("ade2"), F.round("ade_mean", 4).alias("ade4"))


# ---- joins ------------------------------------------------------------------------

@query("jn01_context_join", with_tables(A.ERRORS, A.GAMES, """
ctx AS (SELECT log_file, min(year) AS year, count(*) AS n_rows FROM errors WHERE proc_set_file <> 'g5' GROUP BY log_file)""", body="""
SELECT e.log_file, e.year, c.year AS ctx_year, c.n_rows, count(*) AS n FROM errors e LEFT JOIN ctx c USING (log_file) GROUP BY ALL"""))
def context_join(spark, sf):
    e = A.errors(spark, sf)
    ctx = e.where("proc_set_file <> 'g5'").groupBy("log_file").agg(F.min("year").alias("year"), F.count(F.lit(1)).alias("n_rows"))
    return J.context_join(e.select("log_file", "year"), ctx, ["log_file"], "ctx_").groupBy(
        "log_file", "year", "ctx_year", "n_rows").agg(F.count(F.lit(1)).alias("n"))


@query("jn02_one_to_one", with_tables(A.ERRORS, """
f AS (SELECT o_orderkey AS traj_id, o_totalprice / 100 AS accel FROM orders WHERE o_orderkey % 200 <> 7)""", body="""
SELECT year, count(*) AS n, count(accel) AS n_accel, round(sum(accel), 4) AS total FROM errors LEFT JOIN f USING (traj_id) GROUP BY year"""))
def one_to_one(spark, sf):
    f = A.table(spark, sf, "orders").where("o_orderkey % 200 <> 7").select(
        F.col("o_orderkey").alias("traj_id"), (F.col("o_totalprice") / 100).alias("accel"))
    out = J.one_to_one(A.errors(spark, sf).select("traj_id", "year"), f, ["traj_id"], "accel")
    return out.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count("accel").alias("n_accel"), F.round(F.sum("accel"), 4).alias("total"))


@query("jn03_default_dimension", with_tables(A.ERRORS, A.GAMES, A.DIVISIONS, body="""
SELECT proc_set_file, year, coalesce(division, 'Unknown') AS division FROM games LEFT JOIN divisions USING (proc_set_file)"""))
def default_dimension(spark, sf):
    return J.lookup(A.games(spark, sf), A.divisions(spark, sf), ["proc_set_file"], "division", "Unknown").select(
        "proc_set_file", "year", "division")


@query("jn04_inner_context", with_tables(A.ERRORS, A.GAMES, A.DETECTIONS, A.STEPS, """
ctx AS (SELECT game AS proc_set_file, avg(sqrt(vx * vx + vy * vy)) AS speed FROM steps GROUP BY game)""", body="""
SELECT proc_set_file, year, round(ade_mean, 6) AS ade_mean, round(speed, 6) AS speed FROM games JOIN ctx USING (proc_set_file)"""))
def inner_context(spark, sf):
    ctx = A.steps(spark, sf).groupBy(F.col("game").alias("proc_set_file")).agg(F.avg(F.hypot("vx", "vy")).alias("speed"))
    return G.rounded(A.games(spark, sf).join(ctx, "proc_set_file").drop("n_traj"), "ade_mean", "speed")


@query("jn05_year_summary", with_tables(A.ERRORS, """
w AS (SELECT year, count(*) AS n_large FROM errors WHERE ade_traj > 9.999 GROUP BY year)""", body="""
SELECT year, count(*) AS n, coalesce(max(n_large), 0) AS n_large FROM errors LEFT JOIN w USING (year) GROUP BY year"""))
def year_summary(spark, sf):
    e = A.errors(spark, sf)
    n = e.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    large = e.where("ade_traj > 9.999").groupBy("year").agg(F.count(F.lit(1)).alias("n_large"))
    return n.join(large, "year", "left").select("year", "n", F.coalesce("n_large", F.lit(0)).alias("n_large"))


@query("jn06_pivot_context", with_tables(A.ERRORS, body="""
SELECT proc_set_file, year, round(avg(ade_traj) FILTER (model = '1-URGENT'), 6) AS urgent,
       round(avg(ade_traj) FILTER (model = '5-LOW'), 6) AS low, min(log_file) AS log_file FROM errors GROUP BY proc_set_file, year"""))
def pivot_context(spark, sf):
    e, key = A.errors(spark, sf), ["proc_set_file", "year"]
    wide = e.groupBy(*key).pivot("model", ["1-URGENT", "5-LOW"]).agg(F.avg("ade_traj"))
    wide = wide.select(*key, F.round("1-URGENT", 6).alias("urgent"), F.round("5-LOW", 6).alias("low"))
    return wide.join(G.first_by(e, key, ["log_file"], ["log_file"]), key, "left")


@query("jn07_band_pairs", with_tables(A.ERRORS, """
g AS (SELECT proc_set_file, year, model, count(*) AS n, avg(ade_traj) AS ade FROM errors GROUP BY ALL)""", body=f"""
SELECT y.year, y.model AS model_y, y.proc_set_file AS game_y, b.proc_set_file AS game_b, b.model AS model_b, y.n AS n_y, b.n AS n_b
FROM g y JOIN g b ON y.year <> {A.BASE_YEAR} AND b.year = {A.BASE_YEAR} AND abs(y.n - b.n) / b.n <= 0.2"""))
def band_pairs(spark, sf):
    g = A.errors(spark, sf).groupBy("proc_set_file", "year", "model").agg(F.count(F.lit(1)).alias("n"))
    y = g.where(F.col("year") != A.BASE_YEAR).select(
        "year", F.col("model").alias("model_y"), F.col("proc_set_file").alias("game_y"), F.col("n").alias("n_y"))
    b = g.where(F.col("year") == A.BASE_YEAR).select(
        F.col("proc_set_file").alias("game_b"), F.col("model").alias("model_b"), F.col("n").alias("n_b"))
    return J.band_pairs(y, b, "n_y", "n_b", 0.20)


HISTORY_SQL = """
asks AS (SELECT robot_id, t, frame, row_number() OVER () AS z FROM detections WHERE kind = 'click'),
balls AS (SELECT robot_id, t, frame, x, row_number() OVER (PARTITION BY robot_id ORDER BY t, frame) - 1 AS no FROM detections WHERE kind = 'view'),
pos AS (SELECT a.robot_id, a.frame, count(b.no) AS k FROM asks a LEFT JOIN balls b ON a.robot_id = b.robot_id AND b.t < a.t GROUP BY ALL),
slots AS (SELECT robot_id, frame, k - 5 + s AS want, s FROM pos, range(5) r(s))"""


@query("jn08_ball_history", with_tables(A.DETECTIONS, HISTORY_SQL, body="""
SELECT s.robot_id, s.frame, round(sum(b.x * (s + 1)), 4) AS weighted_x, count(*) FILTER (want >= 0) AS n_real, count(b.x) AS n_filled
FROM slots s LEFT JOIN balls b ON b.robot_id = s.robot_id AND b.no = greatest(want, 0) GROUP BY s.robot_id, s.frame"""))
def ball_history(spark, sf):
    d = A.detections(spark, sf)
    h = J.history(d.where("kind = 'click'"), d.where("kind = 'view'"), ["robot_id"], "t", "frame", "frame", ["x"], 5)
    placed = F.transform("x", lambda v, i: v * (i + 1))
    total = F.aggregate(F.filter(placed, lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v)
    found = F.size(F.filter("x", lambda v: v.isNotNull()))
    return h.select("robot_id", "frame", F.round(F.when(found > 0, total), 4).alias("weighted_x"),
                    F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("n_real"), found.cast("bigint").alias("n_filled"))


PAIR_SQL = """
a AS (SELECT model, idx FROM channels WHERE channel = 0), b AS (SELECT model, idx FROM channels WHERE channel = 1),
near AS (SELECT a.model, a.idx, arg_min(b.idx, abs(b.idx - a.idx) * 1000000 - b.idx) AS partner, min(abs(b.idx - a.idx)) AS gap
         FROM a JOIN b USING (model) GROUP BY a.model, a.idx)"""


def two_channels(spark, sf):
    c = A.channels(spark, sf)
    return c.where("channel = 0"), c.where("channel = 1")


@query("jn09_nearest_alarm", with_tables(A.ERRORS, A.STREAM, A.CHANNELS, PAIR_SQL,
       body="SELECT model, idx, partner, gap FROM near WHERE gap <= 10"))
def nearest_alarm(spark, sf):
    a, b = two_channels(spark, sf)
    return J.nearest(a, b, ["model"]).where("gap <= 10")


@query("jn10_closest_pair", with_tables(A.ERRORS, A.STREAM, A.CHANNELS, PAIR_SQL, body="""
SELECT model, min(gap) AS delta_min, arg_min(idx, gap * 1000000 + idx) AS a_idx, arg_min(partner, gap * 1000000 + idx) AS b_idx
FROM near GROUP BY model"""))
def closest_pair(spark, sf):
    return J.closest_pair(*two_channels(spark, sf), ["model"])


@query("jn11_sampled_games", with_tables(A.ERRORS, A.DIVISIONS, body="""
SELECT year, count(*) AS n FROM errors WHERE proc_set_file IN (SELECT proc_set_file FROM divisions WHERE division = 'A') GROUP BY year"""))
def sampled_games(spark, sf):
    chosen = A.divisions(spark, sf).where("division = 'A'")
    return A.errors(spark, sf).join(chosen, "proc_set_file", "left_semi").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("jn12_complement", with_tables(A.ERRORS, A.DIVISIONS, body="""
SELECT year, count(*) AS n FROM errors WHERE proc_set_file NOT IN (SELECT proc_set_file FROM divisions WHERE division = 'A') GROUP BY year"""))
def complement(spark, sf):
    chosen = A.divisions(spark, sf).where("division = 'A'")
    return A.errors(spark, sf).join(chosen, "proc_set_file", "left_anti").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("jn13_inferred_first", with_tables(A.ERRORS, A.DIVISIONS, body="""
SELECT coalesce(CASE WHEN o.o_orderkey % 3 = 0 THEN 'A' END, division, 'Both') AS division, count(*) AS n
FROM orders o LEFT JOIN divisions ON proc_set_file = 'g' || (o_custkey % 6) GROUP BY 1"""))
def inferred_first(spark, sf):
    e = A.errors(spark, sf).withColumn(
        "log_file", F.when(F.col("traj_id") % 3 == 0, F.concat(F.lit("2024_DIV-A_"), "log_file")).otherwise(F.col("log_file")))
    out = J.lookup(e, A.divisions(spark, sf), ["proc_set_file"], "division", "Both", scalars.division_of(F.col("log_file")))
    return out.groupBy("division").agg(F.count(F.lit(1)).alias("n"))


@query("jn14_config_grid", with_tables(A.ERRORS, "grid AS (SELECT d.delta, w.w FROM (VALUES (0.5), (1.0), (2.0)) d(delta), (VALUES (3), (6)) w(w))",
       body="""SELECT model, CAST(delta AS DOUBLE) AS delta, w, count(*) FILTER (ade_traj > delta * w) AS n FROM errors, grid GROUP BY ALL"""))
def config_grid(spark, sf):
    grid = [{"delta": d, "w": w} for d in (0.5, 1.0, 2.0) for w in (3, 6)]
    return J.expand(A.errors(spark, sf).select("model", "ade_traj"), grid, {"delta": "double", "w": "int"}).groupBy(
        "model", "delta", "w").agg(F.count_if(F.col("ade_traj") > F.col("delta") * F.col("w")).alias("n"))


@query("jn15_result_lookup", with_tables(A.ERRORS, A.GAMES, body="""
SELECT e.traj_id, g.n_traj FROM errors e JOIN games g ON g.proc_set_file = e.proc_set_file AND g.year = e.year
WHERE e.year = 2001 AND e.model = '5-LOW'"""))
def result_lookup(spark, sf):
    rows = A.errors(spark, sf).where("year = 2001 AND model = '5-LOW'")
    return rows.join(J.small(A.games(spark, sf)), ["proc_set_file", "year"]).select("traj_id", "n_traj")


# ---- sets ----------------------------------------------------------------------------

@query("set01_union_all", with_tables(A.ERRORS, body="""
SELECT src, count(*) AS n FROM (SELECT 'early' AS src FROM errors WHERE year < 1998 UNION ALL SELECT 'late' FROM errors WHERE year > 1996) GROUP BY src"""))
def union_all(spark, sf):
    e = A.errors(spark, sf)
    part = lambda c, n: e.where(c).select(F.lit(n).alias("src"))
    return part("year < 1998", "early").unionByName(part("year > 1996", "late")).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("set02_or_gate", with_tables(A.ERRORS, A.STREAM, body="""
SELECT model, idx FROM stream WHERE ade_traj > 9.3 UNION SELECT model, idx FROM stream WHERE ade_traj < 0.5"""))
def or_gate(spark, sf):
    s = A.stream(spark, sf).df.select("model", "idx", "ade_traj")
    return s.where("ade_traj > 9.3").select("model", "idx").union(s.where("ade_traj < 0.5").select("model", "idx")).distinct()


@query("set03_channel_flags", with_tables(A.ERRORS, A.STREAM, A.CHANNELS, body="""
SELECT model, idx // 50 AS slot, bool_or(channel = 0) AS in_a, bool_or(channel = 1) AS in_b,
       bool_or(channel = 0) AND bool_or(channel = 1) AS both FROM channels GROUP BY model, idx // 50"""))
def channel_flags(spark, sf):
    c = A.channels(spark, sf).groupBy("model", F.floor(F.col("idx") / 50).alias("slot")).agg(
        F.bool_or(F.col("channel") == 0).alias("in_a"), F.bool_or(F.col("channel") == 1).alias("in_b"))
    return c.withColumn("both", F.col("in_a") & F.col("in_b"))


@query("set04_year_agreement", with_tables(A.ERRORS, """
a AS (SELECT DISTINCT year FROM errors WHERE ade_traj > 9.99), b AS (SELECT DISTINCT year FROM errors WHERE ade_traj < 0.01)""", body="""
SELECT year, 'both' AS side FROM (SELECT year FROM a INTERSECT SELECT year FROM b)
UNION ALL SELECT year, 'only_a' FROM (SELECT year FROM a EXCEPT SELECT year FROM b)
UNION ALL SELECT year, 'only_b' FROM (SELECT year FROM b EXCEPT SELECT year FROM a)"""))
def year_agreement(spark, sf):
    e = A.errors(spark, sf)
    a, b = e.where("ade_traj > 9.99").select("year").distinct(), e.where("ade_traj < 0.01").select("year").distinct()
    tag = lambda d, n: d.withColumn("side", F.lit(n))
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "only_a")).unionByName(tag(b.exceptAll(a), "only_b"))


@query("set05_distinct_rows", with_tables(A.ERRORS, body="SELECT DISTINCT proc_set_file, log_file, model FROM errors"))
def distinct_rows(spark, sf):
    return A.errors(spark, sf).select("proc_set_file", "log_file", "model").distinct()


# ---- scalar functions ------------------------------------------------------------------

@query("sc01_math", """SELECT event_id, round(sqrt(value * value + event_id * event_id), 6) AS h, round(sqrt(value), 6) AS r, round(abs(value - 50), 6) AS a,
 round(ln(1 + value), 6) AS l1, round(log10(value), 6) AS l10, round(ln(value), 6) AS ln, CAST(floor(value) AS BIGINT) AS f, CAST(ceil(value) AS BIGINT) AS c,
 round(sin(value), 6) AS s, round(cos(value), 6) AS co, round(atan2(value, event_id + 1), 6) AS at, round(exp(-value / 100), 6) AS e FROM events""")
def math_functions(spark, sf):
    v, i = F.col("value"), F.col("event_id")
    out = {"h": F.hypot(v, i), "r": F.sqrt(v), "a": F.abs(v - 50), "l1": F.log1p(v), "l10": F.log10(v), "ln": F.log(v), "s": F.sin(v),
           "co": F.cos(v), "at": F.atan2(v, i + 1), "e": F.exp(-v / 100)}
    return A.table(spark, sf, "events").select(
        "event_id", *[F.round(c, 6).alias(n) for n, c in out.items()], F.floor(v).alias("f"), F.ceil(v).alias("c"))


@query("sc02_wrapped_angle", """SELECT event_id, round(((value + pi()) - 2 * pi() * floor((value + pi()) / (2 * pi()))) - pi(), 6) AS wrapped,
 round(abs(value), 6) AS plain FROM events""")
def wrapped_angle(spark, sf):
    return A.table(spark, sf, "events").select(
        "event_id", F.round(scalars.wrap_angle("value"), 6).alias("wrapped"), F.round(F.abs("value"), 6).alias("plain"))


VECTORS = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def vectors(spark, sf):
    return A.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query("sc03_array_features", with_tables(VECTORS, body="""
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(list_avg(v), 6) AS mean,
       round(list_aggregate(v, 'quantile_cont', 0.9), 6) AS p90,
       round(list_sum(list_transform(range(1, len(v)), lambda i: abs(v[i + 1] - v[i]))), 6) AS travel FROM e"""))
def array_features(spark, sf):
    v = F.col("v")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return vectors(spark, sf).select(
        "vec_id", F.round(F.sqrt(total(F.transform(v, lambda x: x * x))), 6).alias("norm"), F.round(scalars.array_mean(v), 6).alias("mean"),
        F.round(scalars.array_quantile(v, 0.9), 6).alias("p90"),
        F.round(total(F.transform(scalars.array_diff(v), lambda d: F.abs(d))), 6).alias("travel"))


@query("sc04_displacement", with_tables(VECTORS, body="""
SELECT vec_id, round(list_avg(list_transform(range(1, 16), lambda i: sqrt(pow(v[i] - v[i + 30], 2) + pow(v[i + 15] - v[i + 45], 2)))), 6) AS ade,
       round(sqrt(pow(v[15] - v[45], 2) + pow(v[30] - v[60], 2)), 6) AS fde FROM e"""))
def displacement(spark, sf):
    part = lambda a: F.slice("v", a, 15)
    m = scalars.displacement(part(1), part(16), part(31), part(46))
    return vectors(spark, sf).select("vec_id", F.round(m["ade"], 6).alias("ade"), F.round(m["fde"], 6).alias("fde"))


FORECAST = """SELECT vec_id, round(v[1] + 15 * v[2], 6) AS last, round(list_sum(list_transform(range(1, 16), lambda i: v[1] + i * v[2])), 6) AS total FROM e"""


@query("sc05_constant_velocity", with_tables(VECTORS, body=FORECAST))
def constant_velocity(spark, sf):
    p = scalars.constant_velocity(F.col("v")[0], F.col("v")[1], 15)
    return vectors(spark, sf).select("vec_id", F.round(F.element_at(p, -1), 6).alias("last"),
                                     F.round(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("sc06_transition_forecast", with_tables(VECTORS, body=FORECAST))
def transition_forecast(spark, sf):
    p = scalars.transition_forecast(F.col("v")[0], F.col("v")[1], 15)
    return vectors(spark, sf).select("vec_id", F.round(F.element_at(p, -1), 6).alias("last"),
                                     F.round(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("sc07_scaling_roundtrip", with_tables(A.DETECTIONS, "s AS (SELECT avg(x) AS m, stddev_pop(x) AS d FROM detections)", body="""
SELECT frame, round((x - m) / d, 6) AS z, round((x - m) / d * d + m, 6) AS back FROM detections, s"""))
def scaling_roundtrip(spark, sf):
    d = A.detections(spark, sf)
    stats = d.agg(F.struct(F.avg("x").alias("m"), F.stddev_pop("x").alias("d")).alias("s")).scalar()
    z = d.withColumn("_s", stats).withColumn("z", scalars.normalise(F.col("x"), F.col("_s.m"), F.col("_s.d")))
    return z.select("frame", F.round("z", 6).alias("z"), F.round(scalars.denormalise(F.col("z"), F.col("_s.m"), F.col("_s.d")), 6).alias("back"))


@query("sc08_names", with_tables(A.ERRORS, body=r"""
SELECT DISTINCT match_id, CAST(nullif(regexp_extract(match_id, '((?:19|20)\d{2})', 1), '') AS INTEGER) AS year_found,
  CAST(nullif(regexp_extract(proc_set_file, '(\d+)', 1), '') AS BIGINT) AS number_found,
  year || '_' || regexp_replace(regexp_replace(regexp_replace(log_file, '\.log', ''), '^\d{4}-\d{2}-\d{2}_\d{2}-\d{2}_', ''), '[^A-Za-z0-9_-]+', '_', 'g') AS short_name,
  CAST(regexp_extract('delta=1e-05, mw=600, cd=200, xw=2000', 'mw=([0-9.e+-]+)', 1) AS DOUBLE) + year AS mw FROM errors"""))
def names(spark, sf):
    cfg = scalars.config_text(F.lit("1e-05"), F.lit(600), F.lit(200), F.lit(2000))
    return A.errors(spark, sf).select(
        "match_id", scalars.first_year("match_id").alias("year_found"), scalars.first_number("proc_set_file").alias("number_found"),
        scalars.match_name(F.col("year"), F.lit(""), F.col("log_file"), F.col("proc_set_file")).alias("short_name"),
        (scalars.config_value(cfg, "mw") + F.col("year")).alias("mw")).distinct()


@query("sc09_durations", "SELECT user_id, count(*) / 60.0 AS seconds, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id")
def durations(spark, sf):
    us = F.unix_micros(F.max(F.col("ts").cast("timestamp")))
    return A.table(spark, sf, "events").groupBy("user_id").agg(
        (F.count(F.lit(1)) / 60.0).cast("double").alias("seconds"), F.unix_micros(F.timestamp_micros(us)).alias("last_us"))


@query("sc10_recovery_notes", with_tables(A.ERRORS, A.WEIGHTED, f"""
m AS (SELECT year, avg(ade_traj) AS a, sum(w * ade_traj) / sum(w) AS iw, sum(w) * sum(w) / (count(*) * sum(w * w)) AS ess FROM weighted GROUP BY year),
x AS (SELECT m.year, m.iw, m.ess, m.a - b.a AS ex, CASE WHEN m.a - b.a > 1e-6 THEN (m.a - m.iw) / (m.a - b.a) * 100 END AS raw
      FROM m JOIN m b ON b.year = {A.BASE_YEAR})""", body="""
SELECT year, round(ex, 6) AS excess_total, round(raw, 4) AS recovery_raw, round(CASE WHEN raw IS NOT NULL THEN least(greatest(raw, 0), 100) END, 4) AS recovery_pct,
  coalesce(raw > 100 OR raw < 0, false) AS overshoot, CASE WHEN ex <= 1e-6 THEN 'no_excess' WHEN raw > 100 THEN 'overshoot_high'
  WHEN raw < 0 THEN 'overshoot_low' ELSE 'ok' END AS recovery_note,
  CASE WHEN ess >= 0.5 THEN 'stable' WHEN ess >= 0.3 THEN 'marginal' ELSE 'unstable' END AS regime FROM x"""))
def recovery_notes(spark, sf):
    w = A.weighted(spark, sf)
    sw, n = F.sum("w"), F.count(F.lit(1))
    m = w.groupBy("year").agg(F.avg("ade_traj").alias("a"), (F.sum(F.col("w") * F.col("ade_traj")) / sw).alias("iw"),
                              (sw * sw / (n * F.sum(F.col("w") * F.col("w")))).alias("ess"))
    base = m.where(F.col("year") == A.BASE_YEAR).select("a").scalar()
    out = m.withColumn("_base", base).select("year", *[c.alias(k) for k, c in scalars.recovery_columns(
        F.col("a"), F.col("iw"), F.col("_base")).items()], scalars.regime(F.col("ess")).alias("regime"))
    return G.rounded(G.rounded(out, "excess_total"), "recovery_raw", "recovery_pct", digits=4)


@query("sc11_map_lookup", with_tables(A.ERRORS, body="""
SELECT proc_set_file, CASE proc_set_file WHEN 'g0' THEN 1995 WHEN 'g1' THEN 1996 ELSE -1 END AS mapped, count(*) AS n FROM errors GROUP BY proc_set_file"""))
def map_lookup(spark, sf):
    m = F.create_map(F.lit("g0"), F.lit(1995), F.lit("g1"), F.lit(1996))
    return A.errors(spark, sf).groupBy("proc_set_file", F.coalesce(F.try_element_at(m, F.col("proc_set_file")), F.lit(-1)).alias("mapped")).agg(
        F.count(F.lit(1)).alias("n"))


@query("sc12_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(spark, sf):
    return A.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("sc13_adaptive_parameters", with_tables(A.ERRORS, "n AS (SELECT model, count(*) AS n FROM errors GROUP BY model)", body="""
SELECT model, n, round(least(greatest(5 + 5 * log10(greatest(n, 1) / 1000.0), 8), 50), 6) AS k_thr,
  CAST(floor(least(greatest(n * 0.02, 100), 400)) AS INTEGER) AS min_instances, CAST(floor(least(greatest(n * 0.005, 30), 100)) AS INTEGER) AS cooldown,
  CASE WHEN n < 5000 THEN 1e-3 WHEN n < 50000 THEN 1e-4 ELSE 5e-5 END AS adwin_delta,
  CAST(floor(least(greatest(n * 0.03, 60), 150)) AS INTEGER) AS adwin_min_window FROM n"""))
def adaptive_parameters(spark, sf):
    n = A.errors(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    out = n.select("model", "n", *[c.alias(k) for k, c in scalars.adaptive_parameters(F.col("n")).items()])
    return G.rounded(out, "k_thr")


SNR_SQL = f"""
c AS (SELECT a.model, count(*) FILTER (a.year = {A.BASE_YEAR}) AS b, count(*) FILTER (a.year > {A.BASE_YEAR}) AS p, count(*) AS n FROM alarms a GROUP BY 1),
r AS (SELECT model, count(*) FILTER (year = {A.BASE_YEAR}) AS br, count(*) FILTER (year > {A.BASE_YEAR}) AS pr FROM errors GROUP BY 1)"""


def alarm_totals(spark, sf):
    a = A.alarms(spark, sf).groupBy("model").agg(
        F.count_if(F.col("year") == A.BASE_YEAR).alias("b"), F.count_if(F.col("year") > A.BASE_YEAR).alias("p"), F.count(F.lit(1)).alias("n"))
    return a.join(J.small(A.totals(A.errors(spark, sf), ["model"])), "model")


@query("sc14_detector_metrics", with_tables(A.ERRORS, A.STREAM, A.ALARMS, SNR_SQL, body="""
SELECT model, round(CASE WHEN b = 0 THEN CASE WHEN p > 0 THEN 9999.0 ELSE 0.0 END ELSE least(p * br / (b * pr), 9999.0) END, 6) AS snr_op,
       round((p + 1.0) * br / ((b + 1.0) * pr), 6) AS snr_smooth, round(p / n, 6) AS efficiency FROM c JOIN r USING (model)"""))
def detector_metrics(spark, sf):
    c = [F.col(x) for x in ("p", "b", "base_rows", "post_rows")]
    out = alarm_totals(spark, sf).select(
        "model", metrics.operational_snr(*c).alias("snr_op"), metrics.smoothed_snr(*c).alias("snr_smooth"),
        metrics.detection_efficiency(F.col("p"), F.col("n")).alias("efficiency"))
    return G.rounded(out, "snr_op", "snr_smooth", "efficiency")


@query("sc15_relative_ratio", with_tables(A.ERRORS, A.WEIGHTED, body="SELECT traj_id, round(w / (0.1 * w + 0.9), 6) AS ratio FROM weighted"))
def relative_ratio(spark, sf):
    return A.weighted(spark, sf).select("traj_id", F.round(scalars.relative_ratio("w", 0.1), 6).alias("ratio"))


@query("sc16_criteria", """SELECT o_orderkey, round(greatest(2.0, sqrt(2 * ln(2.0 / (1.0 / (1 + o_orderkey))))), 6) AS z_crit,
 round(o_totalprice / 1000 + (3 * (o_orderkey % 5) + 1) * ln(1 + o_custkey), 4) AS mbic FROM orders""")
def criteria(spark, sf):
    return A.table(spark, sf, "orders").select(
        "o_orderkey", F.round(scalars.z_critical(1.0 / (1 + F.col("o_orderkey"))), 6).alias("z_crit"),
        F.round(scalars.modified_bic(F.col("o_totalprice") / 1000, F.col("o_orderkey") % 5, 1 + F.col("o_custkey")), 4).alias("mbic"))


@query("udf03_sql_functions", with_tables(A.ERRORS, A.STREAM, A.ALARMS, SNR_SQL, """
w AS (SELECT *, b / br AS q FROM c JOIN r USING (model))""", body="""
SELECT model, round(1000.0 * b / greatest(1, br), 6) AS far, round((p + 1.0) * br / ((b + 1.0) * pr), 6) AS snr,
  round(1000 * (q + 3.8416 / (2 * br) + 1.96 * sqrt(q * (1 - q) / br + 3.8416 / (4.0 * br * br))) / (1 + 3.8416 / br), 6) AS wilson_hi FROM w"""))
def sql_functions(spark, sf):
    metrics.register_sql(spark)
    alarm_totals(spark, sf).createOrReplaceTempView("alarm_totals_view")
    return spark.sql("""SELECT model, round(far_per_1k(b, base_rows), 6) AS far, round(smoothed_snr(p, b, base_rows, post_rows), 6) AS snr,
                        round(wilson_high(b, base_rows), 6) AS wilson_hi FROM alarm_totals_view""")


@query("smp01_down_sample", f"""SELECT row_id FROM (SELECT o_orderkey AS row_id FROM orders) ORDER BY {row_hash_sql('row_id', "'42'")}, row_id LIMIT 500""")
def down_sample(spark, sf):
    return hash_cap(A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id")), [], "row_id", 500)
