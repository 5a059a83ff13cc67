"""Queries over change points, per-game series and density ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import aggregates as G
from tidemark.operators import changepoint as C
from tidemark.operators import ratio as R
from tidemark.operators import tracks as T
from tidemark.operators.detectors.linked import detect
from tidemark.operators.ordered import framed, series
from tidemark.plans.catalog import query, with_tables
from tidemark.plans.shift_queries import NAMES, feature_vectors, windows
from tidemark.sources import adapters as A

# ---- change points ---------------------------------------------------------------

MONTHS = """mo0 AS (SELECT o_orderpriority AS model, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS month, avg(o_totalprice / 49999) AS v FROM orders GROUP BY ALL),
mo AS (SELECT model, month, v, CAST((month - 1) // 12 AS INTEGER) AS year, row_number() OVER (PARTITION BY model ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM mo0),
gm AS (SELECT a.model, 1 / (2 * quantile_cont(pow(a.v - b.v, 2), 0.5)) AS gamma FROM mo a JOIN mo b ON a.model = b.model AND a.i < b.i AND a.v <> b.v GROUP BY a.model)"""
COSTS = """kk AS (SELECT a.model, a.i, b.i AS j, exp(-gamma * pow(a.v - b.v, 2)) AS k FROM mo a JOIN mo b ON a.model = b.model JOIN gm ON gm.model = a.model),
rs AS (SELECT model, i, j, sum(k) OVER (PARTITION BY model, i ORDER BY j) AS r FROM kk),
pp AS (SELECT model, i + 1 AS i, j + 1 AS j, sum(r) OVER (PARTITION BY model, j ORDER BY i) AS p FROM rs),
pz AS (SELECT model, i, j, p FROM pp UNION ALL SELECT DISTINCT model, 0, j, 0.0 FROM pp UNION ALL SELECT DISTINCT model, i, 0, 0.0 FROM pp UNION ALL SELECT DISTINCT model, 0, 0, 0.0 FROM pp),
sc AS (SELECT a.model, a.i AS s, b.i AS e, (b.i - a.i) - (b.p - 2 * c.p + a.p) / (b.i - a.i) AS cost
  FROM pz a JOIN pz b ON a.model = b.model AND a.i = a.j AND b.i = b.j AND b.i > a.i JOIN pz c ON c.model = a.model AND c.i = a.i AND c.j = b.i),
ok AS (SELECT * FROM sc WHERE e - s >= 2), nn AS (SELECT model, max(n) AS n FROM mo GROUP BY model),
f0 AS (SELECT model, e, cost FROM ok WHERE s = 0),
f1 AS (SELECT o.model, o.e, min(f0.cost + o.cost) AS cost, arg_min(o.s, f0.cost + o.cost) AS b1 FROM ok o JOIN f0 ON f0.model = o.model AND f0.e = o.s GROUP BY o.model, o.e),
f2 AS (SELECT o.model, o.e, min(f1.cost + o.cost) AS cost, arg_min(o.s, f1.cost + o.cost) AS b2, arg_min(f1.b1, f1.cost + o.cost) AS b1 FROM ok o JOIN f1 ON f1.model = o.model AND f1.e = o.s GROUP BY o.model, o.e)"""
CURVE = """cv AS (SELECT f0.model, CAST(0 AS INTEGER) AS n_breaks, cost, NULL::BIGINT AS last_break FROM f0 JOIN nn ON nn.model = f0.model AND nn.n = f0.e
  UNION ALL SELECT f1.model, 1, cost, b1 FROM f1 JOIN nn ON nn.model = f1.model AND nn.n = f1.e UNION ALL SELECT f2.model, 2, cost, b2 FROM f2 JOIN nn ON nn.model = f2.model AND nn.n = f2.e)"""


def months(spark, sf):
    """Monthly mean error per model: one point per month."""
    o = A.table(spark, sf, "orders")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    m = o.groupBy(F.col("o_orderpriority").alias("model"), month.alias("month")).agg(F.avg(F.col("o_totalprice") / 49999).alias("v"))
    return m.withColumn("year", F.floor((F.col("month") - 1) / 12).cast("int"))


@query("chg01_segment_costs", with_tables(MONTHS, """
kk AS (SELECT a.model, a.year, exp(-gamma * pow(a.v - b.v, 2)) AS k FROM mo a JOIN mo b ON a.model = b.model AND a.year = b.year JOIN gm ON gm.model = a.model),
ln AS (SELECT model, year, count(*) AS n FROM mo GROUP BY model, year)""", body="""
SELECT kk.model, kk.year, n AS length, round(n - sum(k) / n, 6) AS cost FROM kk JOIN ln ON ln.model = kk.model AND ln.year = kk.year GROUP BY kk.model, kk.year, n"""))
def segment_costs(spark, sf):
    """Cost of the calendar years as segments."""
    return G.rounded(C.segment_costs(months(spark, sf), ["model"], "month", "v", "year"), "cost")


@query("chg02_break_curve", with_tables(MONTHS, COSTS, CURVE, body="""
SELECT cv.model, n_breaks, round(cost, 6) AS cost, round(cost + (3 * n_breaks + 1) * ln(n), 6) AS m_bic, n AS length, last_break FROM cv JOIN nn USING (model)"""))
def break_curve(spark, sf):
    c = C.break_curve(months(spark, sf), ["model"], "month", "v", 2)
    return G.rounded(c.withColumn("last_break", F.try_element_at("breaks", F.lit(-1))).drop("breaks"), "cost", "m_bic")


@query("chg02_chosen_breaks", with_tables(MONTHS, COSTS, CURVE, body="""
SELECT cv.model, CAST(arg_min(n_breaks, cost + (3 * n_breaks + 1) * ln(n)) AS INTEGER) AS best_k FROM cv JOIN nn USING (model) GROUP BY cv.model"""))
def chosen_breaks(spark, sf):
    return C.chosen_breaks(C.break_curve(months(spark, sf), ["model"], "month", "v", 2), ["model"])


@query("chg03_penalty_table")
def penalty_table(spark, sf):
    """Breaks per penalty and kernel width: the exact optimum of every cell."""
    p = C.penalty_table(months(spark, sf), ["model"], "month", "v", [0.5, 1.0, 2.0, 3.0, 5.0, 10.0], [0.1, 1.0, 10.0])
    return G.rounded(p.select("model", "factor", "gamma", "penalty", "n_breaks"), "gamma")


@query("chg04_break_periods", with_tables(MONTHS, COSTS, """
lb AS (SELECT f2.model, unnest([b1, b2]) AS i FROM f2 JOIN nn ON nn.model = f2.model AND nn.n = f2.e)""",
    body="SELECT DISTINCT mo.model, mo.year FROM lb JOIN mo ON mo.model = lb.model AND mo.i = lb.i"))
def break_periods(spark, sf):
    m = months(spark, sf)
    c = C.break_curve(m, ["model"], "month", "v", 2).where("n_breaks = 2")
    s = series(m, ["model"], ["month"])
    return C.break_periods(c.select("model", F.explode("breaks").alias("idx")), s, "year")


YEAR_JUMP = """yr AS (SELECT year, avg(ade_traj) AS a FROM errors GROUP BY year), jp AS (SELECT year FROM (SELECT year, abs(a - lag(a) OVER (ORDER BY year)) AS d FROM yr) WHERE d > 0.1)"""


@query("chg04_regime_parts", with_tables(A.ERRORS, YEAR_JUMP, """
u AS (SELECT DISTINCT proc_set_file, e.year, jp.year AS break_year FROM errors e, jp), sd AS (SELECT *, CASE WHEN year < break_year THEN 'before' ELSE 'after' END AS side FROM u),
n AS (SELECT break_year, min(c) >= 10 AND count(*) = 2 AS usable FROM (SELECT break_year, side, count(*) AS c FROM sd GROUP BY ALL) GROUP BY break_year)""",
    body="SELECT proc_set_file, year, sd.break_year, side, usable FROM sd JOIN n ON n.break_year = sd.break_year"))
def regime_parts(spark, sf):
    """Games before and after each year whose mean error jumps."""
    e = A.errors(spark, sf)
    y = e.groupBy("year").agg(F.avg("ade_traj").alias("a")).withColumn("_all", F.lit(1))
    jump = framed(series(y, ["_all"], ["year"]), lambda w: {"d": F.abs(F.col("a") - F.lag("a").over(w))}, 1).where("d > 0.1")
    return T.regime_parts(e, "proc_set_file", "year", jump, least=10)


@query("chg05_run_length_breaks")
def run_length_breaks(spark, sf):
    s = series(months(spark, sf), ["model"], ["month"])
    return C.run_length_breaks(s, "v", hazard=0.05)


def per_game(spark, sf):
    return C.game_series(A.errors(spark, sf), ["model"], "ade_traj", "year", "match_id")


LIB = {"threshold": 0.6, "min_instances": 3}
TWO_SIDED = """gs AS (SELECT model, year, match_id, avg(ade_traj) AS x, row_number() OVER (PARTITION BY model ORDER BY year, match_id) - 1 AS idx FROM errors GROUP BY model, year, match_id),
t2 AS (SELECT model, idx, 1 AS n, x AS mean, -0.005 AS up, 0.005 AS dn, -0.005 AS lo, 0.005 AS hi, false AS hit FROM gs WHERE idx = 0
  UNION ALL SELECT model, idx, n, mean, up, dn, least(lo, up), greatest(hi, dn), n >= 3 AND greatest(up - least(lo, up), greatest(hi, dn) - dn) > 0.6 FROM (
    SELECT model, idx, n, mean, lo, hi, 0.9999 * u0 + x - mean - 0.005 AS up, 0.9999 * d0 + x - mean + 0.005 AS dn FROM (
      SELECT g.model, g.idx, g.x, CASE WHEN t2.hit THEN 1 ELSE t2.n + 1 END AS n, CASE WHEN t2.hit THEN g.x ELSE t2.mean + (g.x - t2.mean) / (t2.n + 1) END AS mean,
        CASE WHEN t2.hit THEN 0 ELSE t2.up END AS u0, CASE WHEN t2.hit THEN 0 ELSE t2.dn END AS d0,
        CASE WHEN t2.hit THEN 1e300 ELSE t2.lo END AS lo, CASE WHEN t2.hit THEN -1e300 ELSE t2.hi END AS hi
      FROM t2 JOIN gs g ON g.model = t2.model AND g.idx = t2.idx + 1)))"""


@query("det05_library_hinkley", with_tables(A.ERRORS, TWO_SIDED, body="SELECT model, idx FROM t2 WHERE hit", recursive=True))
def library_hinkley(spark, sf):
    return detect(per_game(spark, sf), "ade", [{"cfg": "ph", "detector": "two_sided", **LIB}]).drop("cfg")


@query("det05_library_window")
def library_window(spark, sf):
    """The all-cuts window detector with library defaults, on the error rows."""
    return detect(A.stream(spark, sf), "ade_traj", [{"cfg": f"d{d}", "detector": "bucket_window", "bare": True, "delta": d} for d in (0.002, 0.9)])


@query("chg06_game_alarms", with_tables(A.ERRORS, TWO_SIDED, body="""
SELECT t2.model, 'ph' AS cfg, t2.idx, gs.year, gs.match_id, round(gs.x, 6) AS ade FROM t2 JOIN gs ON gs.model = t2.model AND gs.idx = t2.idx WHERE hit""", recursive=True))
def game_alarms(spark, sf):
    out = C.game_alarms(per_game(spark, sf), "ade", [{"cfg": "ph", "detector": "two_sided", **LIB}], ["year", "match_id"])
    return G.rounded(out.select("model", "cfg", "idx", "year", "match_id", "ade"), "ade")


@query("chg06_alarm_summary", with_tables(A.ERRORS, TWO_SIDED, body="""
SELECT t2.model, gs.year, count(*) AS n_alarms FROM t2 JOIN gs ON gs.model = t2.model AND gs.idx = t2.idx WHERE hit GROUP BY t2.model, gs.year""", recursive=True))
def alarm_summary(spark, sf):
    return game_alarms(spark, sf).groupBy("model", "year").agg(F.count(F.lit(1)).alias("n_alarms"))


# ---- density ratios ------------------------------------------------------------------

COORDS = [f"e{i}" for i in range(1, 9)]


def samples(spark, sf):
    """Embedding rows: labels below five are the baseline, the others the targets."""
    e = A.table(spark, sf, "embeddings")
    x = e.select("vec_id", F.col("label").alias("period"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COORDS)])
    return x.where("period < 5").drop("period"), x.where("period >= 5")


@query("dst10_pooled_scaling", "WITH e AS (SELECT label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), k AS (SELECT DISTINCT label AS period FROM e WHERE label >= 5) "
       "SELECT CAST(period AS INTEGER) AS period, count(*) AS n, round(avg(a), 6) AS e1_mean, round(stddev_pop(a), 6) AS e1_std, round(avg(b), 6) AS e2_mean, round(stddev_pop(b), 6) AS e2_std "
       "FROM k JOIN e ON e.label < 5 OR e.label = k.period GROUP BY period")
def pooled_scaling(spark, sf):
    """Mean and deviation of baseline and target together, from two sets of sums."""
    base, target = samples(spark, sf)
    both = base.withColumn("period", F.explode(target.agg(F.collect_set("period")).scalar())).unionByName(target)
    aggs = [F.count(F.lit(1)).alias("n")] + [f(c).alias(f"{c}_{t}") for c in ("e1", "e2") for f, t in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return G.rounded(both.groupBy("period").agg(*aggs), "e1_mean", "e1_std", "e2_mean", "e2_std")


@query("dst12_lsif_weights")
def lsif_weights(spark, sf):
    base, target = samples(spark, sf)
    w = R.fit_ratio(base, target, "period", COORDS, "vec_id").weigh(target, "period", ["vec_id"])
    return G.rounded(w.select("period", "vec_id", "w"), "w")


@query("dst13_relative_weights")
def relative_weights(spark, sf):
    base, target = samples(spark, sf)
    w = R.fit_ratio(base, target, "period", COORDS, "vec_id", alpha=0.1).weigh(target, "period", ["vec_id"])
    return G.rounded(w.select("period", "vec_id", "w"), "w")


def window_table(spark, sf):
    """Windows with features and forecast errors; two games are the baseline."""
    w = windows(spark, sf)
    f = feature_vectors(spark, sf, w)
    e = T.error_rows(w, 3, ["robot_id", "start"], "constant", "6->3").select("robot_id", "start", "ade_traj")
    t = f.join(e, ["robot_id", "start"]).withColumn("row_id", F.col("robot_id") * 1000000 + F.col("start"))
    t = session.cut(t.withColumn("block", (F.col("start") % 6).cast("int")))
    return t.where(F.col("game").isin("g0", "g1")), t.where(~F.col("game").isin("g0", "g1"))


@query("dst14_iw_decomposition")
def iw_decomposition(spark, sf):
    base, target = window_table(spark, sf)
    w = R.fit_ratio(base, target, "game", NAMES, "row_id", 100).weigh(target, "game", ["row_id", "block", "ade_traj"])
    out = R.decomposition(w, base, "game", "ade_traj", "row_id", "block", reps=100)
    return G.rounded(out, *[c for c, t in out.dtypes if t == "double"], digits=4)


@query("dst15_feature_subsets")
def feature_subsets(spark, sf):
    """Each feature alone and each left out, all fitted in one pass."""
    base, target = window_table(spark, sf)
    fit = R.fit_ratio(base, target, "game", NAMES, "row_id", 60, subsets=R.single_and_left_out(NAMES))
    out = R.subset_table(fit.weigh(target, "game", ["ade_traj"]), base, "game", "ade_traj")
    return G.rounded(out, "ade_iw", "ess_ratio", "recovery_raw", "recovery_pct", digits=4)


@query("dst16_ratio_self_test")
def ratio_self_test(spark, sf):
    base, _ = samples(spark, sf)
    return G.rounded(R.self_test(base, COORDS[1:], "e1", "vec_id", 100), "ade_iw", "ess_ratio", "ade_base", "delta", digits=4)


@query("dst18_two_sample_classifier")
def two_sample_classifier(spark, sf):
    """All rows, all coordinates, 200 permutations."""
    e = A.table(spark, sf, "embeddings")
    names = [f"e{i}" for i in range(64)]
    x = e.select("vec_id", F.col("label").alias("period"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    out = R.two_sample_classifier(x.where("period < 5").drop("period"), x.where("period >= 5"), "period", names, "vec_id")
    return G.rounded(out, "auc", "coverage_pct", "p_value")
