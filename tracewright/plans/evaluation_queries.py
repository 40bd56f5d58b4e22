"""Queries of the evaluation chain and the report figures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, evaluation, runs, timeline
from . import reports
from .common import E_SQL, events, r, rounded, rs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _tracks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Views of a user as a track, the mean click of each time as its reference."""
    e = events(spark, d)
    x = F.col("x")
    track = e.where("event_type = 'view' AND x IS NOT NULL").select("k", "event_id", "t", (x * 3).alias("px"), (x - 5).alias("py"), F.lit(1.0).alias("pz"), (x / 10).alias("vx"), (F.lit(4.0) - x / 20).alias("vy"), F.lit(0.5).alias("vz"))
    clicks = e.where("event_type = 'click' AND x IS NOT NULL").groupBy("k", "t").agg(F.avg("x").alias("x")).withColumn("event_id", F.lit(0).cast("long"))
    return track, clicks.select("k", "event_id", "t", (x / 8).alias("speed"), x.alias("heading_deg"), (x * 2).alias("e"), (x - 1).alias("n"), F.lit(0.25).alias("u"))


def _curves_sql(lag_us: int) -> str:
    return f"""
v AS (SELECT k, event_id, t, x * 3 AS px, x - 5 AS py, 1.0::DOUBLE AS pz, x / 10 AS vx, 4 - x / 20 AS vy, 0.5::DOUBLE AS vz, t + {lag_us} AS q FROM e WHERE event_type = 'view' AND x IS NOT NULL AND NOT isnan(x)),
c AS (SELECT k, t, avg(x) AS x FROM e WHERE event_type = 'click' AND x IS NOT NULL AND NOT isnan(x) GROUP BY k, t), m AS (SELECT k, count(*) AS m FROM c GROUP BY k),
b AS (SELECT v.*, c.t AS bt, c.x AS bx FROM v ASOF LEFT JOIN c ON v.k = c.k AND v.q >= c.t), a AS (SELECT b.*, c.t AS att, c.x AS ax FROM b ASOF LEFT JOIN c ON b.k = c.k AND b.q <= c.t),
w AS (SELECT a.*, CASE WHEN bt IS NOT NULL AND att IS NOT NULL AND m >= 2 THEN CASE WHEN att > bt THEN (q - bt) / (att - bt)::DOUBLE ELSE 0 END END AS f FROM a LEFT JOIN m USING (k)),
i AS (SELECT *, bx / 8 + (ax - bx) / 8 * f AS speed, bx * 2 + (ax - bx) * 2 * f AS re, bx - 1 + (ax - bx) * f AS rn, 0.25 + 0 * f AS ru, sin(radians(bx)) + (sin(radians(ax)) - sin(radians(bx))) * f AS he, cos(radians(bx)) + (cos(radians(ax)) - cos(radians(bx))) * f AS hn FROM w),
g AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) - speed AS se, sqrt((px - re) ** 2 + (py - rn) ** 2) AS h, sqrt((px - re) ** 2 + (py - rn) ** 2 + (pz - ru) ** 2) AS pe, degrees(atan2(vx, vy)) - degrees(atan2(he, hn)) AS dh FROM i),
z AS (SELECT *, CASE WHEN sqrt(vx * vx + vy * vy) >= 2 THEN dh - 360 * floor((dh + 180) / 360) END AS hd FROM g)"""


@query(f"WITH {E_SQL}, {_curves_sql(3_600_000_000)} SELECT event_id, {rs('se', 5)} AS speed_error, {rs('pe', 5)} AS position_error, {rs('h', 5)} AS horizontal_error, {rs('hd', 4)} AS heading_error_deg FROM z")
def error_curves(spark: SparkSession, d: str) -> DataFrame:
    """Errors of every track row against the reference an hour later."""
    out = evaluation.error_curves(*_tracks(spark, d), "k", "t", ["event_id"], 3600.0)
    return rounded(out.select("event_id", *evaluation.ERRORS), "speed_error", "position_error", "horizontal_error", digits=5).withColumn("heading_error_deg", r("heading_error_deg", 4))


@query(f"""WITH {E_SQL}, {_curves_sql(0)}, l AS (SELECT k, sum(d) AS len FROM (SELECT k, sqrt((px - lag(px) OVER o) ** 2 + (py - lag(py) OVER o) ** 2) AS d FROM v WINDOW o AS (PARTITION BY k ORDER BY t, event_id)) GROUP BY k),
s AS (SELECT k, (max(t) - min(t)) / 1000000.0::DOUBLE AS dur, sqrt(avg(h * h)) AS rm, avg(se) AS sm, max(abs(hd)) AS hm, arg_max(h, (t, event_id)) FILTER (h IS NOT NULL) AS hf, arg_max(se, (t, event_id)) FILTER (se IS NOT NULL) AS sf, count(pe) AS pn FROM z GROUP BY k)
SELECT k, {rs('dur', 3)} AS duration_s, {rs('coalesce(len, 0)', 4)} AS distance, {rs('rm', 5)} AS horizontal_error_rmse, {rs('sm', 5)} AS speed_error_mean, {rs('hm', 4)} AS heading_error_deg_max, {rs('hf', 5)} AS horizontal_error_final, pn AS position_error_n,
  {rs('CASE WHEN dur > 0 THEN hf / dur END', 10)} AS drift_per_second, {rs('CASE WHEN len > 1 THEN hf / len END')} AS drift_per_distance, {rs('CASE WHEN dur > 0 THEN abs(sf) / dur END', 10)} AS drift_speed FROM s LEFT JOIN l USING (k)""")
def compare_tracks(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.compare(evaluation.error_curves(*_tracks(spark, d), "k", "t", ["event_id"]), "k", "t", ["event_id"])
    return out.select(
        "k", r("duration_s", 3).alias("duration_s"), r("distance", 4).alias("distance"), r("horizontal_error_rmse", 5).alias("horizontal_error_rmse"), r("speed_error_mean", 5).alias("speed_error_mean"), r("heading_error_deg_max", 4).alias("heading_error_deg_max"),
        r("horizontal_error_final", 5).alias("horizontal_error_final"), "position_error_n", r("drift_per_second", 10).alias("drift_per_second"), r("drift_per_distance").alias("drift_per_distance"), r("drift_speed", 10).alias("drift_speed"),
    )


@query(f"""WITH {E_SQL}, s AS (SELECT l_returnflag AS stream, median(l_quantity) AS median, min(l_quantity) AS least, max(l_quantity) AS greatest, count(l_quantity) AS n FROM lineitem GROUP BY 1)
SELECT stream, median::DOUBLE AS median, least::DOUBLE AS least, greatest::DOUBLE AS greatest, n FROM s""")
def rate_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.spread(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("stream"), F.col("l_quantity").cast("double").alias("hz")), ["stream"], "hz")


@query(f"SELECT l_returnflag AS stream, count(l_orderkey)::BIGINT AS n_rows, {rs('sum(l_quantity::DOUBLE) / 3600', 4)} AS hours FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("stream"), F.lit(1).alias("n_rows"), F.col("l_quantity").cast("double").alias("s"))
    return reports.totals(rows, "stream", "n_rows", "s").withColumn("hours", r("hours", 4))


@query("SELECT families, count(*) AS n_groups FROM (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS families FROM lineitem GROUP BY l_orderkey) GROUP BY families")
def duplicate_spread(spark: SparkSession, d: str) -> DataFrame:
    return reports.family_sets(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT sum(n - 1)::BIGINT AS redundant FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def redundant_copies(spark: SparkSession, d: str) -> DataFrame:
    return reports.redundant_copies(table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "n")


@query(f"""WITH {E_SQL}, s AS (SELECT k, t, (t - lag(t) OVER (PARTITION BY k ORDER BY t, event_id)) / 1000000.0::DOUBLE AS dt FROM e),
c AS (SELECT k, stddev_pop(dt) FILTER (dt > 0) / avg(dt) FILTER (dt > 0) AS cv FROM s GROUP BY k), q AS (SELECT *, row_number() OVER (PARTITION BY k % 10 ORDER BY k) AS rk FROM c WHERE cv > 0.9)
SELECT k % 10 AS name, k, {rs('cv')} AS cv FROM q WHERE rk = 1""")
def discontinuous_streams(spark: SparkSession, d: str) -> DataFrame:
    rows = timeline.timing(events(spark, d), "k", ["t", "event_id"], "t").withColumn("name", F.col("k") % 10)
    return reports.discontinuous(rows, "name", ["k"], least=0.9).select("name", "k", r("cv").alias("cv"))


@query(f"""WITH {E_SQL}, a AS (SELECT k, min(t) / 1000000.0::DOUBLE AS a0, max(t) / 1000000.0::DOUBLE AS a1 FROM e WHERE event_type = 'view' GROUP BY k), b AS (SELECT k, min(t) / 1000000.0::DOUBLE AS b0, max(t) / 1000000.0::DOUBLE AS b1 FROM e WHERE event_type = 'click' GROUP BY k),
j AS (SELECT ((a1 - b1) + (a0 - b0)) / 2 AS mean FROM a JOIN b USING (k)), h AS (SELECT round_even(mean / 3600, 0)::INTEGER AS hours, abs(mean - round_even(mean / 3600, 0)::INTEGER * 3600) AS left_s FROM j)
SELECT hours, count(*) AS n, {rs('median(left_s)', 3)} AS median_residual_s, count(*) FILTER (left_s <= 60) AS near_hour FROM h GROUP BY hours""")
def offset_histogram(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return rounded(reports.whole_hours(asof.overlap(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "k", "t")), "median_residual_s", digits=3)


@query(f"""WITH s AS (SELECT o_totalprice::DOUBLE / 1000 AS s, o_orderkey % 500 AS n FROM orders), u AS (SELECT s, CASE WHEN n > 0 THEN s * 1000000 / n END AS us FROM s)
SELECT {rs('avg(us)', 3)} AS mean_us_a_sample, {rs('quantile_cont(us, 0.95)', 3)} AS p95_us_a_sample, {rs('avg(s)')} AS mean_s_a_segment, {rs('quantile_cont(s, 0.95)')} AS p95_s_a_segment, count(*) AS n_segments FROM u""")
def performance_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select((F.col("o_totalprice").cast("double") / 1000).alias("s"), (F.col("o_orderkey") % 500).alias("n"))
    return rounded(rounded(reports.performance(rows, "s", "n"), "mean_us_a_sample", "p95_us_a_sample", digits=3), "mean_s_a_segment", "p95_s_a_segment")


@query(f"""WITH v AS (SELECT label, vec_id % 128 AS f, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT label, {rs('avg(sqrt(x * x + y * y + z * z))')} AS total, {rs('avg(sqrt(x * x + y * y))')} AS horizontal, {rs('avg(abs(z))')} AS vertical, count(*) AS n FROM v WHERE f >= 64 GROUP BY label""")
def resting_residuals(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 128).cast("int").alias("f"), *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    return rounded(reports.resting_residuals(rows, ["label"], "f", ("x", "y", "z")), "total", "horizontal", "vertical")


@query(f"""WITH {E_SQL}, m AS (SELECT *, coalesce(x < 60, false) AS calm FROM e), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) - row_number() OVER (PARTITION BY k, calm ORDER BY t, event_id) AS g FROM m),
s AS (SELECT k, g, min(t) AS a, (max(t) - min(t)) / 1000000.0::DOUBLE AS d FROM w WHERE calm GROUP BY k, g), l AS (SELECT k, d, a, row_number() OVER (PARTITION BY k ORDER BY d DESC, a) AS rk FROM s), f AS (SELECT k, min(t) AS a0 FROM e GROUP BY k)
SELECT k, {rs('d', 3)} AS rest_s, coalesce(d >= 3600 AND (a - a0) / 1000000.0::DOUBLE <= 432000, false) AS begins_at_rest FROM f LEFT JOIN (SELECT * FROM l WHERE rk = 1) USING (k)""")
def begins_at_rest(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("calm", F.coalesce(F.col("x") < 60, F.lit(False)))
    return rounded(evaluation.begins_at_rest(rows, "k", ["t", "event_id"], "t", "calm", 3600.0, 432_000.0), "rest_s", digits=3)


_PAIRS = """p AS (SELECT o_orderkey AS pair, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 97) * 1.5::DOUBLE END AS a0, (o_orderkey % 97) * 1.5::DOUBLE + o_custkey % 300 AS a1, (o_custkey % 31) * 2.0::DOUBLE AS b0, (o_custkey % 31) * 2.0::DOUBLE + o_orderkey % 280 AS b1,
  (o_orderkey % 97) * 1.5::DOUBLE - (o_custkey % 31) * 2.0::DOUBLE + o_orderkey % 7 - 3 AS off, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_custkey % 101) / 100.0::DOUBLE END AS c, (o_orderkey % 13) / 50.0::DOUBLE AS m FROM orders)"""


@query(f"""WITH {_PAIRS}, q AS (SELECT *, ((a0 - b0) + (a1 - b1)) / 2 AS clock, (a1 - b1) - (a0 - b0) AS drift, coalesce(c >= 0.5 AND m >= 0.05, false) AS sig FROM p),
e AS (SELECT *, CASE WHEN sig THEN off ELSE clock END AS est FROM q), v AS (SELECT *, CASE WHEN est IS NOT NULL AND a0 IS NOT NULL THEN greatest(0, least(a1 - est, b1) - greatest(a0 - est, b0)) END AS ov FROM e), f AS (SELECT *, clock IS NULL OR ov < 60 AS undecided FROM v)
SELECT pair, {rs('clock')} AS clock_offset_s, {rs('drift')} AS drift_estimate_s, {rs('est')} AS estimated_offset_s, CASE WHEN clock IS NULL THEN NULL ELSE {rs('ov')} END AS overlap_s, CASE WHEN clock IS NULL THEN 'none' WHEN sig THEN 'speed_cross_correlation' ELSE 'clock_difference' END AS offset_method,
  CASE WHEN undecided THEN 'none' WHEN sig AND c >= 0.8 THEN 'high' WHEN sig THEN 'medium' ELSE 'low' END AS offset_confidence, CASE WHEN undecided THEN 'UNRESOLVED' WHEN sig THEN 'CONFIRMED_BY_SIGNAL' ELSE 'CLOCK_ONLY' END AS status FROM f""")
def sync_offset(spark: SparkSession, d: str) -> DataFrame:
    """What clocks, correlation and margin of a pair decide, for made-up pairs that reach every branch."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    a0, b0 = (key % 97) * 1.5, (cust % 31) * 2.0
    pairs = table(spark, d, "orders").select(
        key.alias("pair"), F.when(key % 11 != 0, a0).alias("a0"), (a0 + cust % 300).alias("a1"), b0.alias("b0"), (b0 + key % 280).alias("b1"), (a0 - b0 + key % 7 - 3).alias("off"), F.when(key % 5 != 0, (cust % 101) / 100).alias("c"), ((key % 13) / 50).alias("m")
    )
    out = asof.synchronize(pairs, "off", "c", "m", ("a0", "a1", "b0", "b1"))
    out = out.withColumn("overlap_s", F.when(F.col("clock_offset_s").isNotNull(), F.col("overlap_s")))
    return rounded(out, "clock_offset_s", "drift_estimate_s", "estimated_offset_s", "overlap_s").select("pair", "clock_offset_s", "drift_estimate_s", "estimated_offset_s", "overlap_s", "offset_method", "offset_confidence", "status")


@query("""WITH p AS (SELECT user_id AS k, CASE user_id % 3 WHEN 0 THEN 'CONFIRMED_BY_SIGNAL' WHEN 1 THEN 'CLOCK_ONLY' ELSE 'UNRESOLVED' END AS status, max(value) AS off, avg(value) / 100 AS c, count(*) % 4 = 0 AS drifting, count(*) / 1000.0::DOUBLE AS cov FROM events GROUP BY user_id)
SELECT round(min(off) FILTER (user), 6) AS least_offset_s, round(max(off) FILTER (user), 6) AS greatest_offset_s, round(median(off) FILTER (user), 6) AS median_offset_s, round(median(c) FILTER (user), 6) AS median_correlation, count(*) FILTER (drifting) AS n_drifting,
  count(*) FILTER (user) AS confirmed_by_signal, count(*) FILTER (status = 'CLOCK_ONLY') AS clock_only, count(*) FILTER (status = 'UNRESOLVED') AS unresolved, round(median(cov), 6) AS median_coverage FROM (SELECT *, status = 'CONFIRMED_BY_SIGNAL' AS user FROM p)""".replace("(user)", "(ok)").replace("AS user FROM p", "AS ok FROM p"))
def sync_figures(spark: SparkSession, d: str) -> DataFrame:
    """The synchronisation report's figures over pairs that are made of every user's events."""
    k = F.col("user_id")
    status = F.when(k % 3 == 0, "CONFIRMED_BY_SIGNAL").when(k % 3 == 1, "CLOCK_ONLY").otherwise("UNRESOLVED")
    pairs = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("estimated_offset_s"), (F.avg("value") / 100).alias("correlation"), (F.count("*") % 4 == 0).alias("drift_detected"), (F.count("*") / 1000).alias("cov")).withColumn("status", status)
    return rounded(reports.sync_figures(pairs, "cov"), "least_offset_s", "greatest_offset_s", "median_offset_s", "median_correlation", "median_coverage")


@query(f"""WITH l AS (SELECT l_suppkey::VARCHAR AS source_file, CASE WHEN l_returnflag = 'R' THEN NULL ELSE ((l_linenumber * l_orderkey) % 40) / 20.0::DOUBLE END AS v FROM lineitem)
SELECT source_file, count(*) AS n_rows, count(v) AS labelled_rows, {rs('count(v) / count(*)::DOUBLE')} AS coverage_fraction, {rs('avg(v)', 5)} AS mean_label_mps, {rs('max(v)', 5)} AS max_label_mps, {rs('count(*) FILTER (v < 0.5) / nullif(count(v), 0)::DOUBLE')} AS stationary_fraction FROM l GROUP BY source_file""")
def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("l_returnflag") != "R", ((F.col("l_linenumber") * F.col("l_orderkey")) % 40) / 20.0)
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_file"), v.alias("ref_velocity_mps"), *[F.lit("").alias(c) for c in ("segment_id", "session_id", "label_source", "label_quality")], F.lit(0).alias("row_idx"))
    out = runs.coverage(rows).drop("segment_id", "session_id", "label_source", "label_quality")
    return rounded(rounded(out, "coverage_fraction", "stationary_fraction"), "mean_label_mps", "max_label_mps", digits=5)


@query(f"""WITH {E_SQL}, v AS (SELECT k, event_id, t, x * 3 AS px, x - 5 AS py, sqrt((x / 10) ** 2 + (4 - x / 20) ** 2 + 0.25) AS v FROM e WHERE event_type = 'view' AND x IS NOT NULL AND NOT isnan(x)),
o AS (SELECT *, sqrt((px - lag(px) OVER w) ** 2 + (py - lag(py) OVER w) ** 2) AS d, row_number() OVER w AS i FROM v WINDOW w AS (PARTITION BY k ORDER BY t, event_id))
SELECT k, count(*) AS samples, (max(t) - min(t)) / 1000000.0::DOUBLE AS duration_s, {rs('arg_max(v, i)')} AS final_speed_mps, {rs('max(v)')} AS max_speed_mps, {rs('sqrt((arg_max(px, i) - arg_min(px, i)) ** 2 + (arg_max(py, i) - arg_min(py, i)) ** 2)', 5)} AS displacement_m, {rs('coalesce(sum(d), 0)', 4)} AS path_length_m FROM o GROUP BY k""")
def trajectory_summary(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.trajectory_summary(_tracks(spark, d)[0], "k", ["t", "event_id"], "t")
    return rounded(out, "final_speed_mps", "max_speed_mps").withColumns({"displacement_m": r("displacement_m", 5), "path_length_m": r("path_length_m", 4)})


@query(f"""WITH s AS (SELECT o_orderkey % 3 > 0 AS ok, o_orderkey % 2 = 0 AS al, o_orderkey % 4 > 0 AS cmp, o_totalprice::DOUBLE AS z, o_custkey::DOUBLE AS lg, o_orderkey % 5 = 0 AS acc FROM orders)
SELECT count(*) AS processed, count(*) FILTER (ok) AS propagated, count(*) FILTER (ok AND al) AS with_alignment, count(*) FILTER (ok AND NOT al) AS without_alignment, count(*) FILTER (ok AND cmp) AS compared, {rs('median(z) FILTER (ok AND cmp)', 4)} AS median_zero_lag_speed_rmse_mps,
  {rs('median(z / 2) FILTER (ok AND cmp)', 4)} AS median_best_lag_speed_rmse_mps, {rs('median(lg * 2) FILTER (ok AND cmp)', 4)} AS median_position_drift_mps, count(*) FILTER (ok AND cmp AND acc) AS with_accepted_lag, {rs('median(lg) FILTER (ok AND cmp AND acc)', 4)} AS median_abs_lag_s FROM s""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    key, z, lag = F.col("o_orderkey"), F.col("o_totalprice").cast("double"), F.col("o_custkey").cast("double")
    rows = table(spark, d, "orders").select((key % 3 > 0).alias("succeeded"), (key % 2 == 0).alias("aligned"), (key % 4 > 0).alias("compared"), z.alias("zero_rmse"), (z / 2).alias("best_rmse"), (lag * 2).alias("position_drift"), (-lag).alias("lag_s"), (key % 5 == 0).alias("lag_accepted"))
    return rounded(evaluation.run_summary(rows), "median_zero_lag_speed_rmse_mps", "median_best_lag_speed_rmse_mps", "median_position_drift_mps", "median_abs_lag_s", digits=4)
