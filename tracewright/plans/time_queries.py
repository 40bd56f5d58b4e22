"""Queries on ordered rows: segments, held values, windows, joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import flags as FL
from ..operators import asof, ordered, runs, timeline
from .common import E_SQL, events, r, rounded, rs

ORDER = ["t", "event_id"]
DAY_S = 86400.0
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SEG = f"""
WITH {E_SQL},
d AS (SELECT *, t - lag(t) OVER (PARTITION BY k ORDER BY t, event_id) AS dt FROM e),
m AS (SELECT k, median(dt) FILTER (dt > 0) AS med FROM d GROUP BY k),
s AS (SELECT d.*, CASE WHEN dt <= -1000000 THEN 'clock_reset' WHEN dt > greatest(med * 3, 3600000000) THEN 'gap' END AS reason FROM d JOIN m USING (k)),
g AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment_no FROM s)
"""


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    return timeline.segment(events(spark, d), "k", ORDER, "t", multiple=3.0, floor_s=3600.0)


@query(_SEG + f"""
, o AS (SELECT *, t - lag(t) OVER (PARTITION BY k, segment_no ORDER BY t, event_id) AS own FROM g)
SELECT k, segment_no, count(*) AS n_rows, min(t) AS start_us, max(t) AS end_us, CASE WHEN segment_no = 0 THEN 'start' ELSE arg_min(reason, t) END AS reason, CASE WHEN segment_no > 0 THEN {rs('max(dt) FILTER (reason IS NOT NULL) / 1000000.0::DOUBLE')} END AS gap_before_s,
       {rs('median(own) FILTER (own > 0) / 1000000.0::DOUBLE', 7)} AS median_interval_s, {rs('1000000.0::DOUBLE / median(own) FILTER (own > 0)', 9)} AS rate_hz, (max(t) - min(t)) / 1000000.0::DOUBLE AS duration_s, count(*) > 1 AND (max(t) - min(t)) / 1000000.0::DOUBLE < 5 AS short
FROM o GROUP BY k, segment_no""")
def gap_segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(timeline.segment_records(_segmented(spark, d), "k", "t", ORDER), "gap_before_s").withColumns({"median_interval_s": r("median_interval_s", 7), "rate_hz": r("rate_hz", 9)})


@query(f"""
WITH {E_SQL}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY k ORDER BY event_id) AS dt FROM (SELECT event_id, k, t % 604800000000 AS t FROM e)),
m AS (SELECT k, median(dt) FILTER (dt > 0) AS med FROM d GROUP BY k),
g AS (SELECT d.*, sum(CASE WHEN dt <= -400000000000 OR dt > greatest(med * 3, 3600000000) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS segment_no FROM d JOIN m USING (k)),
b AS (SELECT *, coalesce(t < lag(t) OVER (PARTITION BY k, segment_no ORDER BY event_id), false) AS backward FROM g), s AS (SELECT *, bool_or(backward) OVER (PARTITION BY k, segment_no) AS torn FROM b)
SELECT event_id, segment_no::BIGINT AS segment_no, backward, row_number() OVER (PARTITION BY k ORDER BY segment_no, CASE WHEN torn THEN t END, event_id) - 1 AS position, row_number() OVER (PARTITION BY k, segment_no ORDER BY CASE WHEN torn THEN t END, event_id) = 1 AS boundary FROM s""")
def segment_order(spark: SparkSession, d: str) -> DataFrame:
    """The clock runs modulo a week, in which rows jump forth and back; drops of more than 400,000 seconds begin a segment."""
    rows = timeline.segment(events(spark, d).withColumn("t", F.col("t") % 604_800_000_000), "k", ["event_id"], "t", 3.0, 3600.0, 400_000.0)
    return timeline.arrange(rows, "k", ["event_id"], "t").select("event_id", "segment_no", "backward", F.col("position").cast("bigint").alias("position"), "boundary")


@query(_SEG + "SELECT event_id, segment_no, t - min(t) OVER (PARTITION BY k, segment_no) AS elapsed_us FROM g")
def segment_elapsed(spark: SparkSession, d: str) -> DataFrame:
    return _segmented(spark, d).select("event_id", "segment_no", "elapsed_us")


@query(f"WITH {E_SQL}, h AS (SELECT event_id, k, t // 3600000000 AS t FROM e) SELECT event_id, count(*) OVER (PARTITION BY k, t) > 1 AS duplicate FROM h")
def dup_timestamps(spark: SparkSession, d: str) -> DataFrame:
    hours = events(spark, d).withColumn("t", F.expr("t div 3600000000"))
    return timeline.duplicate_times(hours, "k", "t").select("event_id", "duplicate")


@query(f"WITH {E_SQL} SELECT event_id, coalesce(t < lag(t) OVER (PARTITION BY k ORDER BY x, event_id), false) AS backward FROM e")
def non_monotonic(spark: SparkSession, d: str) -> DataFrame:
    return timeline.non_monotonic(events(spark, d), "k", ["x", "event_id"], "t").select("event_id", "backward")


@query(f"""
WITH {E_SQL}, c AS (SELECT event_id, k, t % 86400000000 AS t FROM e),
s AS (SELECT *, t - lag(t) OVER (PARTITION BY k ORDER BY event_id) AS dt FROM c)
SELECT k, count(*) FILTER (dt <= -1000000) AS n_resets, count(*) AS n FROM s GROUP BY k""")
def clock_resets(spark: SparkSession, d: str) -> DataFrame:
    rows = timeline.segment(events(spark, d).withColumn("t", F.col("t") % 86_400_000_000), "k", ["event_id"], "t")
    return rows.groupBy("k").agg(F.count_if(F.col("reason") == "clock_reset").alias("n_resets"), F.count("*").alias("n"))


_FRESH = f"""
WITH {E_SQL}, h AS (SELECT *, floor(x / 10) AS v FROM e),
c AS (SELECT *, v IS DISTINCT FROM lag(v) OVER w AS fresh FROM h WINDOW w AS (PARTITION BY k ORDER BY t, event_id)),
l AS (SELECT *, last_value(CASE WHEN fresh THEN t END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS a_t,
      t - last_value(CASE WHEN fresh THEN t END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM c),
m AS (SELECT k, greatest(median(gap) FILTER (fresh AND gap > 0) * 1.2::DOUBLE / 1000000, 1) AS lim FROM l GROUP BY k)
"""


@query(_FRESH + f"SELECT event_id, fresh, {rs('(t - a_t) / 1000000.0::DOUBLE')} AS held_s, coalesce((t - a_t) / 1000000.0::DOUBLE > lim, false) AS stale FROM l JOIN m USING (k)")
def staleness_locf(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.freshness(events(spark, d).withColumn("v", F.floor(F.col("x") / 10)), "k", ORDER, "t", ["v"], multiple=1.2)
    return rounded(rows.select("event_id", "fresh", "held_s", "stale"), "held_s")


@query(_FRESH + f""", u AS (SELECT k, t, (t - lag(t) OVER (PARTITION BY k ORDER BY t, event_id)) / 1000000.0::DOUBLE AS g FROM c WHERE fresh), n AS (SELECT k, count(*) AS n_rows, avg((x >= 0)::INTEGER) AS availability FROM e GROUP BY k)
SELECT k, any_value(n_rows) AS n_rows, {rs('any_value(availability)')} AS availability, count(*) AS updates, {rs('median(g) FILTER (g > 0)', 3)} AS median_s, {rs('quantile_cont(g, 0.9) FILTER (g > 0)', 3)} AS p90_s, {rs('max(g) FILTER (g > 0)', 3)} AS max_s,
  {rs('CASE WHEN max(t) > min(t) THEN (count(*) - 1) / ((max(t) - min(t)) / 1000000.0::DOUBLE) END', 9)} AS rate_hz FROM u JOIN n USING (k) GROUP BY k""")
def staleness_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.update_intervals(events(spark, d).withColumn("v", F.floor(F.col("x") / 10)), "k", ORDER, "t", ["v"], F.col("x") >= 0)
    return rounded(rounded(rows, "median_s", "p90_s", "max_s", digits=3), "availability").withColumn("rate_hz", r("rate_hz", 9))


def _types(spark: SparkSession, d: str, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d)
    pick = lambda kind: e.where(F.col("event_type") == kind).select("event_id", "k", "t", "x")
    return pick(a), pick(b)


def _bracket(a: str, b: str) -> str:
    return f"""
WITH {E_SQL}, p AS (SELECT * FROM e WHERE event_type = '{a}'), s AS (SELECT k, t, x FROM e WHERE event_type = '{b}'),
q AS (SELECT p.event_id, p.k, p.t, p.x, b.t AS bt, b.x AS bx FROM p ASOF LEFT JOIN s b ON p.k = b.k AND p.t >= b.t),
z AS (SELECT q.*, a.t AS a_t, a.x AS ax FROM q ASOF LEFT JOIN s a ON q.k = a.k AND q.t <= a.t)
"""


@query(_bracket("purchase", "view") + f"""
, n AS (SELECT *, a_t IS NULL OR t - bt <= a_t - t AS early, CASE WHEN a_t IS NULL OR t - bt <= a_t - t THEN t - bt ELSE a_t - t END / 1000000.0::DOUBLE AS dt FROM z)
SELECT event_id, CASE WHEN dt <= 86400 THEN CASE WHEN early THEN bx ELSE ax END END AS near,
       CASE WHEN dt <= 86400 THEN {rs('CASE WHEN early THEN -dt ELSE dt END')} END AS near_dt_s FROM n""")
def asof_nearest_tol(spark: SparkSession, d: str) -> DataFrame:
    a, b = _types(spark, d, "purchase", "view")
    return rounded(asof.nearest(a, b.select("event_id", "k", "t", F.col("x").alias("v")), "k", "t", ["event_id"], "v", "near", DAY_S).select("event_id", "near", "near_dt_s"), "near_dt_s")


_LERP = "CASE WHEN a_t > bt THEN bx + (ax - bx) * (t - bt) / (a_t - bt) ELSE bx END"


@query(_bracket("click", "view") + f"SELECT event_id, {rs(f'CASE WHEN least(t - bt, a_t - t) / 1000000.0::DOUBLE <= 43200 AND a_t IS NOT NULL AND bt IS NOT NULL THEN {_LERP} END')} AS v FROM z")
def asof_interpolate(spark: SparkSession, d: str) -> DataFrame:
    a, b = _types(spark, d, "click", "view")
    out = asof.interpolate(a, b.withColumnRenamed("x", "y"), "k", "t", ["event_id"], "y", "v", DAY_S / 2)
    return rounded(out.select("event_id", "v"), "v")


@query(f"""
WITH {E_SQL}, r AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY t, event_id) - 1) * 400000 AS u FROM e WHERE event_type IN ('click', 'view')),
c AS (SELECT k, u, x FROM r WHERE event_type = 'click' AND x IS NOT NULL), n AS (SELECT k, count(*) AS n FROM c GROUP BY k),
p AS (SELECT *, k % 7 > 0 AND k % 3 < 2 AS tied, u - CASE WHEN k % 7 > 0 AND k % 3 = 1 THEN 300000 ELSE 0 END AS ta, event_id % 2 = 0 AS fresh FROM r WHERE event_type = 'view'),
own AS (SELECT k, coalesce(bool_or(x IS NOT NULL), false) AND bool_or(fresh) AS own FROM p GROUP BY k),
b AS (SELECT p.*, c.u AS bu, c.x AS bx FROM p ASOF LEFT JOIN c ON c.k = p.k AND p.ta >= c.u),
z AS (SELECT b.*, c.u AS au, c.x AS ax FROM b ASOF LEFT JOIN c ON c.k = b.k AND b.ta <= c.u),
l AS (SELECT z.*, own, CASE WHEN tied AND bu IS NOT NULL AND au IS NOT NULL AND least(ta - bu, au - ta) <= 500000 THEN CASE WHEN au > bu THEN bx + (ax - bx) * (ta - bu) / (au - bu)::DOUBLE ELSE bx END END AS ref,
  CASE WHEN tied THEN CASE WHEN coalesce(n, 0) < 2 THEN 'UNAVAILABLE' WHEN k % 3 = 0 THEN 'TIER_1_VEHICLE_SYNCED' ELSE 'TIER_2_VEHICLE_CLOCK' END WHEN own THEN 'TIER_3_SMARTPHONE_GNSS' ELSE 'UNAVAILABLE' END AS label_source
  FROM z JOIN own USING (k) LEFT JOIN n USING (k))
SELECT event_id, label_source, CASE label_source WHEN 'TIER_1_VEHICLE_SYNCED' THEN 'high' WHEN 'TIER_2_VEHICLE_CLOCK' THEN 'medium' WHEN 'TIER_3_SMARTPHONE_GNSS' THEN 'low' ELSE 'none' END AS label_quality,
  {rs("(CASE WHEN label_source LIKE 'TIER_1%' OR label_source LIKE 'TIER_2%' THEN ref WHEN label_source LIKE 'TIER_3%' AND fresh THEN x END)::FLOAT::DOUBLE", 4)} AS label,
  (1 + CASE WHEN label_source LIKE 'TIER_3%' OR label_source = 'UNAVAILABLE' THEN {FL.QUALITY["REFERENCE_LOW_CONFIDENCE"]} ELSE 0 END + CASE WHEN k % 7 > 0 AND k % 3 = 2 THEN {FL.QUALITY["SYNC_UNRESOLVED"]} ELSE 0 END)::INTEGER AS flags FROM l""")
def label_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Labels of every user's views, from clicks as the vehicle's speeds, whose clocks some pairs share, some miss by 0.3 s, and some couldn't bring together."""
    w = W.partitionBy("k").orderBy("t", "event_id")
    both = events(spark, d).where("event_type IN ('click', 'view')").withColumn("i", F.row_number().over(w) - 1)
    phone = F.col("event_type") == "view"
    user = F.col("k").cast("string")
    rows = both.select(
        "k", "event_id", F.when(phone, "smartphone").otherwise("vehicle").alias("stream"), F.lit("f").alias("dataset_family"), user.alias("session_id"), F.concat(F.when(phone, "S-").otherwise("V-"), user).alias("source_file"), user.alias("segment_id"), F.col("i").alias("row_idx"),
        (F.col("i") * 0.4).alias("time_of_day_s"), F.when(phone, F.col("x")).alias("gnss_speed_mps"), F.when(~phone, F.col("x")).alias("ref_speed_mps"), (F.col("event_id") % 2 == 0).alias("gnss_position_fresh"), F.lit(FL.QUALITY["MISSING_SENSOR"]).alias("quality_flags"),
    )
    status = F.when(F.col("k") % 3 == 0, "CONFIRMED_BY_SIGNAL").when(F.col("k") % 3 == 1, "CLOCK_ONLY").otherwise("UNRESOLVED")
    sync = rows.where("k % 7 > 0").select("k").distinct().select(F.concat(F.lit("S-"), F.col("k").cast("string")).alias("smartphone_file"), F.concat(F.lit("V-"), F.col("k").cast("string")).alias("vehicle_file"), status.alias("status"), F.when(F.col("k") % 3 == 1, 0.3).otherwise(0.0).alias("estimated_offset_s"))
    out = runs.label(rows, sync)
    return out.select("event_id", "label_source", "label_quality", r(F.col("ref_velocity_mps").cast("double"), 4).alias("label"), F.col("quality_flags").alias("flags"))


@query(f"""
WITH {E_SQL}, g AS (SELECT k, unnest(range(min(t), max(t) + 1, 86400000000)) AS t FROM e GROUP BY k),
s AS (SELECT k, t, x FROM e),
q AS (SELECT g.k, g.t, b.t AS bt, b.x AS bx FROM g ASOF LEFT JOIN s b ON g.k = b.k AND g.t >= b.t),
z AS (SELECT q.*, a.t AS a_t, a.x AS ax FROM q ASOF LEFT JOIN s a ON q.k = a.k AND q.t <= a.t)
SELECT k, t, {rs(_LERP)} AS v FROM z""")
def resample_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(asof.resample(events(spark, d).drop("event_type"), "k", "t", ["event_id"], "x", DAY_S, "v").select("k", "t", "v"), "v")


@query()
def lag_correlation(spark: SparkSession, d: str) -> DataFrame:
    bins = events(spark, d).groupBy("event_type", F.expr("t div 21600000000").alias("i")).agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("m"))
    return rounded(asof.lag_search(bins, "event_type", "i", "n", "m", 6), "correlation", "margin")


SQL["lag_correlation"] = f"""
WITH {E_SQL}, b AS (SELECT event_type, t // 21600000000 AS i, count(*)::DOUBLE AS n, avg(x) AS m FROM e GROUP BY ALL),
p AS (SELECT a.event_type, l.lag, a.n AS x, c.m AS y FROM b a, (SELECT unnest(range(-6, 7)) AS lag) l, b c WHERE c.event_type = a.event_type AND c.i = a.i + l.lag),
r AS (SELECT event_type, lag, count(*) AS n, corr(x, y) AS r FROM p GROUP BY ALL HAVING count(*) >= 10 AND stddev_pop(x) >= 1e-9 AND stddev_pop(y) >= 1e-9),
w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(r, 9) DESC, lag) AS rk, median(r) OVER (PARTITION BY event_type) AS med FROM r)
SELECT event_type, lag::INTEGER AS lag, {rs('r')} AS correlation, {rs('r - med')} AS margin, n FROM w WHERE rk = 1"""


@query(f"""
WITH {E_SQL}, a AS (SELECT k, min(t) / 1000000.0::DOUBLE AS a0, max(t) / 1000000.0::DOUBLE AS a1 FROM e WHERE event_type = 'view' GROUP BY k),
b AS (SELECT k, min(t) / 1000000.0::DOUBLE AS b0, max(t) / 1000000.0::DOUBLE AS b1 FROM e WHERE event_type = 'click' GROUP BY k),
j AS (SELECT *, (a1 - b1 + a0 - b0) / 2 AS mean, (a1 - b1) - (a0 - b0) AS drift FROM a JOIN b USING (k)),
h AS (SELECT *, round_even(mean / 3600, 0)::INTEGER AS hours FROM j)
SELECT k, {rs('greatest(0, least(a1, b1) - greatest(a0, b0))', 3)} AS overlap_s, {rs('greatest(0, least(a1 - mean, b1) - greatest(a0 - mean, b0))', 3)} AS aligned_overlap_s, {rs('a0 - b0', 3)} AS offset_start_s, {rs('a1 - b1', 3)} AS offset_end_s,
  {rs('drift', 3)} AS drift_s, {rs('mean', 3)} AS offset_mean_s, {rs('CASE WHEN b1 > b0 THEN drift / (b1 - b0) * 1000000 END', 3)} AS drift_ppm, hours AS whole_hours, {rs('mean - hours * 3600', 3)} AS residual_s,
  CASE WHEN hours <> 0 AND abs(mean - hours * 3600) <= 5 AND abs(drift) <= 0.05 THEN 'constant_offset_whole_hour_likely_timezone' WHEN abs(drift) <= 0.05 THEN 'constant_offset' ELSE 'variable_offset_possible_drift' END AS interpretation
FROM h""")
def pair_overlap(spark: SparkSession, d: str) -> DataFrame:
    a, b = _types(spark, d, "view", "click")
    return rounded(asof.overlap(a, b, "k", "t"), "overlap_s", "aligned_overlap_s", "offset_start_s", "offset_end_s", "drift_s", "offset_mean_s", "drift_ppm", "residual_s", digits=3)


@query(f"""
WITH {E_SQL}, a AS (SELECT k, min(t) / 1000000.0::DOUBLE AS a0, max(t) / 1000000.0::DOUBLE AS a1 FROM e WHERE event_type = 'view' GROUP BY k),
b AS (SELECT k, min(t) / 1000000.0::DOUBLE AS b0, max(t) / 1000000.0::DOUBLE AS b1 FROM e WHERE event_type = 'click' GROUP BY k),
j AS (SELECT *, CASE WHEN k % 5 > 0 THEN k * 1.5::DOUBLE END AS off, (k % 10) / 10.0::DOUBLE AS r, (k % 7) / 20.0::DOUBLE AS m FROM a FULL JOIN b USING (k)),
c AS (SELECT *, ((a0 - b0) + (a1 - b1)) / 2 AS clock, (a1 - b1) - (a0 - b0) AS drift, coalesce(off IS NOT NULL AND r >= 0.5 AND m >= 0.05, false) AS s FROM j),
o AS (SELECT *, CASE WHEN s THEN off ELSE clock END AS est FROM c),
v AS (SELECT *, greatest(a0 - est, b0) AS v0, least(a1 - est, b1) AS v1 FROM o),
w AS (SELECT *, CASE WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN greatest(0, v1 - v0) END AS lap FROM v)
SELECT k, {rs('clock', 3)} AS clock_offset_s, {rs('drift', 3)} AS drift_estimate_s, abs(drift) > 1 AS drift_detected, {rs('est', 3)} AS estimated_offset_s,
  CASE WHEN clock IS NULL THEN 'none' WHEN s THEN 'speed_cross_correlation' ELSE 'clock_difference' END AS offset_method,
  CASE WHEN clock IS NULL OR lap < 60 THEN 'none' WHEN s AND r >= 0.8 THEN 'high' WHEN s THEN 'medium' ELSE 'low' END AS offset_confidence,
  CASE WHEN clock IS NULL OR lap < 60 THEN 'UNRESOLVED' WHEN s THEN 'CONFIRMED_BY_SIGNAL' ELSE 'CLOCK_ONLY' END AS status FROM w""")
def sync_offset(spark: SparkSession, d: str) -> DataFrame:
    """What clocks and a best lag decide for each pair; the lag's offset, correlation and margin are made of the key here."""
    ends = lambda df, s: df.groupBy("k").agg((F.min("t") / 1e6).alias(f"{s}0"), (F.max("t") / 1e6).alias(f"{s}1"))
    a, b = _types(spark, d, "view", "click")
    k = F.col("k")
    pairs = ends(a, "a").join(ends(b, "b"), "k", "full").withColumns({"off": F.when(k % 5 > 0, k * 1.5), "r": (k % 10) / 10.0, "m": (k % 7) / 20.0})
    out = asof.synchronize(pairs, "off", "r", "m", ("a0", "a1", "b0", "b1"))
    out = out.select("k", "clock_offset_s", "drift_estimate_s", "drift_detected", "estimated_offset_s", "offset_method", "offset_confidence", "status")
    return rounded(out, "clock_offset_s", "drift_estimate_s", "estimated_offset_s", digits=3)



@query(f"""
WITH {E_SQL}, p AS (
  SELECT k, count(*)::DOUBLE AS n, corr(x, t) AS r, (max(t) - min(t)) / 1000000.0::DOUBLE AS span FROM e GROUP BY k)
SELECT k, CASE WHEN span < 60 OR n <= 60 THEN 'UNRESOLVED' WHEN r >= 0.5 AND n / 1000 >= 0.05 THEN 'CONFIRMED_BY_SIGNAL' ELSE 'CLOCK_ONLY' END AS status FROM p""")
def sync_status(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).groupBy("k").agg(F.count("*").alias("n"), F.corr("x", "t").alias("r"), ((F.max("t") - F.min("t")) / 1e6).alias("span"))
    clock = F.col("n") > 60
    pairs = rows.select("k", "r", (F.col("n") / 1000).alias("m"), F.lit(0.0).alias("off"), *[F.when(clock, F.lit(0.0)).alias(c) for c in ("a0", "b0")], *[F.when(clock, F.col("span")).alias(c) for c in ("a1", "b1")])
    return asof.synchronize(pairs, "off", "r", "m", ("a0", "a1", "b0", "b1")).select("k", "status")


_TRAIL = "OVER (PARTITION BY k ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)"


@query(f"WITH {E_SQL} SELECT event_id, count(x) {_TRAIL} AS n, {rs(f'avg(x) {_TRAIL}')} AS mean FROM e")
def rolling_mean_range(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.trailing(events(spark, d), "k", ["event_id"], "t", "x", DAY_S, "w")
    return rows.select("event_id", F.col("w_n").alias("n"), r("w_mean").alias("mean"))


@query(f"WITH {E_SQL} SELECT event_id, CASE WHEN count(x) {_TRAIL} >= 2 THEN {rs(f'stddev_pop(x) {_TRAIL}', 4)} END AS std FROM e")
def rolling_std_range(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.trailing(events(spark, d), "k", ["event_id"], "t", "x", DAY_S, "w")
    return rows.select("event_id", r("w_std", 4).alias("std"))


_RUN = """
WITH {e}, m AS (SELECT *, {mask} AS m FROM e),
i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) - row_number() OVER (PARTITION BY k, m ORDER BY t, event_id) AS g, lead(t) OVER (PARTITION BY k ORDER BY t, event_id) AS nt FROM m),
runs AS (SELECT k, g, count(*) AS n, min(t) AS start_us, max(t) AS end_us, arg_max(coalesce(nt, -1), t) AS nx FROM i WHERE m GROUP BY k, g)
"""


@query(_RUN.format(e=E_SQL, mask="x < 20") + """
SELECT k, start_us, end_us, n, (end_us - start_us) / 1000000.0::DOUBLE AS duration_s
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY end_us - start_us DESC, start_us) AS rk FROM runs) WHERE rk = 1""")
def stationary_runs(spark: SparkSession, d: str) -> DataFrame:
    return ordered.longest_run(events(spark, d).withColumn("m", F.col("x") < 20), "k", ORDER, "t", "m")


@query(f"""
WITH {E_SQL}, m AS (SELECT *, x < 20 AS m, lag(x < 20) OVER w AS pm, (t - lag(t) OVER w) / 1000000.0::DOUBLE AS dt FROM e WINDOW w AS (PARTITION BY k ORDER BY t, event_id))
SELECT k, {rs('coalesce(sum(dt) FILTER (m AND pm AND dt > 0), 0)', 3)} AS rest_s FROM m GROUP BY k""")
def stationary_seconds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ordered.rest_seconds(events(spark, d).withColumn("m", F.col("x") < 20), "k", ORDER, "t", "m"), "rest_s", digits=3)


@query(_RUN.format(e=E_SQL, mask="event_type = 'error'") + "SELECT k, n, start_us, end_us, nullif(nx, -1) AS next_us FROM runs")
def contiguous_runs(spark: SparkSession, d: str) -> DataFrame:
    return ordered.runs(events(spark, d).withColumn("m", F.col("event_type") == "error"), "k", ORDER, "t", "m")


@query(_RUN.format(e=E_SQL, mask="event_type = 'error'") + """
SELECT k, n, start_us, (coalesce(nullif(nx, -1), end_us) - start_us) / 1000000.0::DOUBLE AS duration_s FROM runs
WHERE (coalesce(nullif(nx, -1), end_us) - start_us) / 1000000.0::DOUBLE >= 3600""")
def outage_intervals(spark: SparkSession, d: str) -> DataFrame:
    return ordered.outages(events(spark, d).withColumn("m", F.col("event_type") == "error"), "k", ORDER, "t", "m", 3600.0).select("k", "n", "start_us", "duration_s")


@query(f"""
WITH {E_SQL}, c AS (SELECT *, floor(x / 50) AS v FROM e),
u AS (SELECT *, v IS DISTINCT FROM lag(v) OVER (PARTITION BY k ORDER BY t, event_id) OR row_number() OVER (PARTITION BY k ORDER BY t, event_id) = 1 AS c FROM c),
h AS (SELECT k, t AS start_us, lead(t) OVER (PARTITION BY k ORDER BY t, event_id) AS end_us FROM u WHERE c)
SELECT *, (end_us - start_us) / 1000000.0::DOUBLE AS duration_s FROM h WHERE (end_us - start_us) / 1000000.0::DOUBLE >= 86400""")
def position_holds(spark: SparkSession, d: str) -> DataFrame:
    return ordered.holds(events(spark, d).withColumn("v", F.floor(F.col("x") / 50)), "k", ORDER, "t", ["v"], DAY_S)


@query(f"""
WITH {E_SQL}, s AS (SELECT event_id, (lead(t) OVER w - lag(t) OVER w) / 1000000.0::DOUBLE AS dt, lead(x) OVER w - lag(x) OVER w AS dx FROM e WINDOW w AS (PARTITION BY k ORDER BY t, event_id))
SELECT event_id, CASE WHEN dt > 0 THEN {rs('dx / dt', 9)} END AS rate FROM s""")
def central_difference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ordered.central_difference(events(spark, d), "k", ORDER, "t", "x").select("event_id", "rate"), "rate", digits=9)


@query(f"""
WITH {E_SQL}, u AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY event_id) = 1 AND x IS NOT NULL),
s AS (SELECT event_id, (t - lag(t) OVER w) / 1000000.0::DOUBLE AS h, (lead(t) OVER w - t) / 1000000.0::DOUBLE AS d, x - lag(x) OVER w AS a, lead(x) OVER w - x AS b FROM u WINDOW w AS (PARTITION BY k ORDER BY t, event_id)),
g AS (SELECT event_id, CASE WHEN h IS NOT NULL AND d IS NOT NULL THEN (h * h * b + d * d * a) / (h * d * (h + d)) WHEN d IS NOT NULL THEN b / d WHEN h IS NOT NULL THEN a / h END AS g FROM s)
SELECT e.event_id, {rs('g', 9)} AS gradient FROM e LEFT JOIN g USING (event_id)""")
def nonuniform_gradient(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ordered.gradient(events(spark, d), "k", ["event_id"], "t", "x").select("event_id", "gradient"), "gradient", digits=9)


@query(f"""
WITH {E_SQL}, a AS (SELECT *, coalesce((x + lag(x) OVER w) / 2 * (t - lag(t) OVER w) / 1000000, 0) AS a FROM e WINDOW w AS (PARTITION BY k ORDER BY t, event_id))
SELECT event_id, {rs('sum(a) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)', 2)} AS integral FROM a""")
def trapezoid_integral(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ordered.integrate(events(spark, d), "k", ORDER, "t", "x").select("event_id", "integral"), "integral", digits=2)


@query(f"""
WITH {E_SQL}, c AS (SELECT event_id, k, (t // 1000000) * 7919 % 1000003 AS t FROM e),
m AS (SELECT *, max(t) OVER (PARTITION BY k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c)
SELECT event_id, t FROM m WHERE m IS NULL OR t > m""")
def strictly_increasing(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_id", "k", F.expr("(t div 1000000) * 7919 % 1000003").alias("t"))
    return timeline.strictly_increasing(rows, "k", ["event_id"], "t").select("event_id", "t")


@query(f"""
WITH {E_SQL}, s AS (SELECT event_id, k, (t - lag(t) OVER (PARTITION BY k ORDER BY t, event_id)) / 1000000.0::DOUBLE AS dt FROM e),
m AS (SELECT k, median(dt) FILTER (dt > 0) AS med FROM s GROUP BY k)
SELECT event_id, CASE WHEN dt IS NULL THEN 'NOT_FINITE' WHEN dt <= 0 THEN 'NON_POSITIVE' WHEN dt > 43200 THEN 'TOO_LARGE' ELSE 'VALID' END AS verdict,
       coalesce(dt > med * 5 OR dt < med / 5, false) AS irregular FROM s JOIN m USING (k)""")
def dt_policy(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("dt", timeline.step("k", ORDER, "t") / 1e6)
    rows = rows.join(rows.groupBy("k").agg(F.median(F.when(F.col("dt") > 0, F.col("dt"))).alias("med")), "k")
    return rows.select("event_id", timeline.step_verdict(F.col("dt"), 43200.0).alias("verdict"), timeline.is_irregular(F.col("dt"), F.col("med")).alias("irregular"))


@query(f"""
WITH {E_SQL}, s AS (SELECT *, x / 100000 AS a, (t - lag(t) OVER (PARTITION BY k ORDER BY t, event_id)) / 1000000.0::DOUBLE AS dt FROM e),
o AS (SELECT *, coalesce(dt > 0 AND dt <= 86400 AND a IS NOT NULL, false) AS ok FROM s),
b AS (SELECT *, CASE WHEN lag(ok) OVER w THEN lag(a) OVER w ELSE a END AS a0 FROM o WINDOW w AS (PARTITION BY k ORDER BY t, event_id)),
v AS (SELECT *, CASE WHEN ok THEN (a0 + a) / 2 * dt ELSE 0 END AS dv FROM b),
w AS (SELECT *, sum(dv) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS velocity FROM v)
SELECT event_id, NOT ok AS held, {rs('velocity', 4)} AS velocity,
  {rs('sum(CASE WHEN ok THEN (velocity - dv / 2) * dt ELSE 0 END) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)', 0)} AS position FROM w""")
def mechanize_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.mechanize(events(spark, d).withColumn("a", F.col("x") / 100000), "k", ORDER, "t", "a", DAY_S)
    return rows.select("event_id", "held", r("velocity", 4).alias("velocity"), r("position", 0).alias("position"))


@query(f"""
WITH {E_SQL}, i AS (SELECT *, row_number() OVER w - 1 AS i, t - lag(t) OVER w AS dt FROM e WINDOW w AS (PARTITION BY k ORDER BY t, event_id)),
n AS (SELECT k, min(t) AS a, max(t) AS b, median(dt) FILTER (dt > 0) AS m FROM i GROUP BY k),
g AS (SELECT k, m, unnest(range(a + 172800000000, b + 1, 86400000000)) AS g FROM n),
j AS (SELECT g.k, g.g AS end_us, m, count(*) AS n, min(i) AS first_row, max(i) AS last_row, arg_max(x, i) AS label, bit_or((event_id % 8)::INTEGER) AS flags
      FROM g JOIN i ON i.k = g.k AND i.t BETWEEN g.g - 172800000000 AND g.g GROUP BY g.k, g.g, m)
SELECT k, end_us, n, first_row, last_row, label, flags, {rs('least(1, n / greatest(1, 172800000000 / m))')} AS coverage FROM j
WHERE n >= 2 AND least(1, n / greatest(1, 172800000000 / m)) >= 0.3 AND label IS NOT NULL""")
def causal_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("f", (F.col("event_id") % 8).cast("int"))
    out = asof.windows(rows, "k", ["event_id"], "t", "x", "f", 2 * DAY_S, DAY_S, 0.3)
    return rounded(out.select("k", "end_us", "n", F.col("first_row").cast("long"), F.col("last_row").cast("long"), "label", "flags", "coverage"), "coverage")


@query(f"""
WITH {E_SQL}, s AS (SELECT k, t, (t - lag(t) OVER (PARTITION BY k ORDER BY t, event_id)) / 1000000.0::DOUBLE AS dt FROM e),
a AS (SELECT k, count(*) AS n, avg(dt) FILTER (dt > 0) AS mean, stddev_pop(dt) FILTER (dt > 0) AS std, min(dt) FILTER (dt > 0) AS lo, max(dt) FILTER (dt > 0) AS hi,
  quantile_cont(dt, 0.25) FILTER (dt > 0) AS q1, quantile_cont(dt, 0.5) FILTER (dt > 0) AS q2, quantile_cont(dt, 0.75) FILTER (dt > 0) AS q3, quantile_cont(dt, 0.99) FILTER (dt > 0) AS p99,
  count(*) FILTER (dt < 0) AS n_negative, count(*) FILTER (dt = 0) AS n_zero, count(*) - count(DISTINCT t) AS n_duplicate, (max(t) - min(t)) / 1000000.0::DOUBLE AS duration_s FROM s GROUP BY k)
SELECT k, n, n_negative, n_zero, n_duplicate, {rs('duration_s', 3)} AS duration_s, {rs('mean', 3)} AS mean_s, {rs('std', 3)} AS std_s, {rs('lo', 3)} AS min_s, {rs('hi', 3)} AS max_s, {rs('q2', 3)} AS median_s, {rs('p99', 3)} AS p99_s,
  {rs('q3 - q1', 3)} AS iqr_s, {rs('std / mean')} AS cv, {rs('(q3 - q1) / q2')} AS irregularity,
  CASE WHEN std / mean <= 0.05 THEN 'stable' WHEN std / mean <= 0.2 THEN 'mostly_stable' WHEN std / mean <= 1 THEN 'irregular' WHEN std IS NULL THEN 'unknown' ELSE 'severely_irregular' END AS sampling FROM a""")
def timing_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = rounded(timeline.timing(events(spark, d), "k", ORDER, "t"), "duration_s", "mean_s", "std_s", "min_s", "max_s", "median_s", "p99_s", "iqr_s", digits=3)
    return rounded(rows, "cv", "irregularity")


@query(f"""
WITH {E_SQL}, p AS (SELECT k, t, event_id, x AS a, x * (event_id % 7) AS b FROM e),
s AS (SELECT *, sqrt((a - lag(a) OVER w) ** 2 + (b - lag(b) OVER w) ** 2) AS d FROM p WINDOW w AS (PARTITION BY k ORDER BY t, event_id))
SELECT k, {rs('sum(d)', 3)} AS distance, {rs('sqrt((arg_max(a, t) - arg_min(a, t)) ** 2 + (arg_max(b, t) - arg_min(b, t)) ** 2)', 3)} AS displacement, count(*) AS n FROM s GROUP BY k""")
def path_length(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("a", F.col("x")).withColumn("b", F.col("x") * (F.col("event_id") % 7))
    return rounded(ordered.path_length(rows, "k", ORDER, ["a", "b"]), "distance", "displacement", digits=3)


@query(f"""
WITH {E_SQL}, f AS (SELECT k, (event_id % 128)::INTEGER AS m FROM e),
b AS (SELECT * FROM (VALUES ('ALIGNMENT_LOW_CONFIDENCE', 1), ('ALIGNMENT_UNAVAILABLE', 2), ('IRREGULAR_DT', 4), ('DUPLICATE_TIMESTAMP', 8), ('LARGE_TIME_GAP', 16), ('INVALID_SENSOR', 32), ('STATIONARY', 64)) v(flag, bit))
SELECT k, flag, count(*) AS n FROM f JOIN b ON (m & bit) <> 0 GROUP BY k, flag""")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("m", (F.col("event_id") % 128).cast("int"))
    return FL.counts(rows, "m", FL.NAVIGATION, ["k"])


@query(f"""
WITH {E_SQL}, f AS (SELECT event_id, (event_id % 1024)::INTEGER AS m FROM e)
SELECT event_id, CASE WHEN m = 0 THEN 'VALID' ELSE concat_ws('|', CASE WHEN m & 1 <> 0 THEN 'MISSING_SENSOR' END, CASE WHEN m & 2 <> 0 THEN 'INVALID_TIMESTAMP' END, CASE WHEN m & 4 <> 0 THEN 'DUPLICATE_TIMESTAMP' END,
  CASE WHEN m & 8 <> 0 THEN 'NON_MONOTONIC_TIMESTAMP' END, CASE WHEN m & 16 <> 0 THEN 'ENCODING_WARNING' END, CASE WHEN m & 32 <> 0 THEN 'SCHEMA_REPAIR' END, CASE WHEN m & 64 <> 0 THEN 'GNSS_STALE' END,
  CASE WHEN m & 128 <> 0 THEN 'SYNC_UNRESOLVED' END, CASE WHEN m & 256 <> 0 THEN 'REFERENCE_LOW_CONFIDENCE' END, CASE WHEN m & 512 <> 0 THEN 'SEGMENT_BOUNDARY' END) END AS names FROM f""")
def flag_names(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.array_join(FL.names((F.col("event_id") % 1024).cast("int")), "|").alias("names"))
