"""Queries that aggregate: profiles, fits, errors, duplicates, splits, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import vectors as V
from ..operators import asof, frames, navigation, ordered, quality, splits, timeline
from .common import E_SQL, events, r, rounded, rs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
_ONE = """SELECT '{c}' AS "column", count(*) AS n_rows, count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = '') AS n_blank,
  count(*) FILTER ({c} IS NOT NULL AND trim({c}::VARCHAR) <> '' AND try_cast({c}::VARCHAR AS DOUBLE) IS NULL) AS n_non_numeric, count(try_cast({c}::VARCHAR AS DOUBLE)) AS n_numeric,
  min(try_cast({c}::VARCHAR AS DOUBLE)) AS min, max(try_cast({c}::VARCHAR AS DOUBLE)) AS max, (round(avg(try_cast({c}::VARCHAR AS DOUBLE)), 4) + 0.0) AS mean, (round(stddev_pop(try_cast({c}::VARCHAR AS DOUBLE)), 4) + 0.0) AS std,
  coalesce(min(try_cast({c}::VARCHAR AS DOUBLE)) = max(try_cast({c}::VARCHAR AS DOUBLE)), false) AS constant FROM lineitem"""
_PROFILE = " UNION ALL ".join(_ONE.format(c=c) for c in _COLS)


@query(_PROFILE)
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.profile(table(spark, d, "lineitem"), _COLS), "mean", "std", digits=4)


@query(f"SELECT \"column\", n_rows, {rs('100.0 * n_blank / n_rows')} AS missing_pct, {rs('100.0 * n_non_numeric / n_rows')} AS non_numeric_pct FROM ({_PROFILE})")
def missingness(spark: SparkSession, d: str) -> DataFrame:
    out = quality.missingness(quality.profile(table(spark, d, "lineitem"), _COLS))
    return rounded(out.select("column", "n_rows", "missing_pct", "non_numeric_pct"), "missing_pct", "non_numeric_pct")


_BANDS = [("l_quantity", 0.0, 40.0, "possible_valid_extreme"), ("l_discount", 0.0, 0.05, "possible_data_error"), ("l_tax", 0.0, 1.0, "possible_data_error")]


@query(f"""WITH p AS ({_PROFILE}), b AS (SELECT * FROM (VALUES ('l_quantity', 0.0, 40.0, 'possible_valid_extreme'), ('l_discount', 0.0, 0.05, 'possible_data_error'), ('l_tax', 0.0, 1.0, 'possible_data_error')) v(c, lo, hi, i))
SELECT "column", min, max, i AS interpretation FROM p JOIN b ON c = "column" WHERE min < lo OR max > hi
UNION ALL SELECT "column", min, max, 'possible_sensor_artifact' FROM p JOIN b ON c = "column" WHERE constant""")
def range_findings(spark: SparkSession, d: str) -> DataFrame:
    p = quality.profile(table(spark, d, "lineitem"), _COLS)
    return quality.range_findings(p, "column", _BANDS).select("column", "min", "max", "interpretation")


@query(f"""WITH {E_SQL}, a AS (SELECT k, 100.0::DOUBLE * avg((x < 1)::INTEGER) AS miss, stddev_pop(x) / avg(x) AS cv, avg((event_type <> 'error')::INTEGER) AS av, count(*) FILTER (x > 200) AS f, count(*) AS n FROM e GROUP BY k)
SELECT k, round_even((round_even(greatest(0, 1 - f / n::DOUBLE), 4) + round_even(greatest(0, 1 - miss / 100), 4) + CASE WHEN cv IS NULL THEN 0 WHEN cv <= 0.05 THEN 1 WHEN cv <= 0.2 THEN 0.75 WHEN cv <= 1 THEN 0.4 ELSE 0.1 END::DOUBLE + round_even(av, 4)) / 4, 4) AS score FROM a""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    a = events(spark, d).groupBy("k").agg(F.count("*").alias("n"), (100.0 * F.avg((F.col("x") < 1).cast("int"))).alias("miss"), (F.stddev_pop("x") / F.avg("x")).alias("cv"), F.avg((F.col("event_type") != "error").cast("int")).alias("av"), F.count_if(F.col("x") > 200).alias("f"))
    return a.select("k", quality.quality_score(*quality.sub_scores(F.col("f"), F.col("n"), F.col("miss"), timeline.sampling_class(F.col("cv")), F.col("av"))).alias("score"))


@query("SELECT l_returnflag, CASE WHEN count(*) >= 10 AND stddev_pop(l_quantity) >= 1e-9 THEN round(corr(l_quantity, l_extendedprice), 6) + 0.0 END AS r, round(sqrt(avg(l_tax * l_tax)), 6) + 0.0 AS rms FROM lineitem GROUP BY l_returnflag")
def pearson_guarded(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(r(asof.guarded_corr(F.col("l_quantity"), F.col("l_extendedprice"), 10, 1e-9)).alias("r"), r(frames.rmse(F.col("l_tax"))).alias("rms"))


@query("""WITH h AS (SELECT l_suppkey AS k, l_discount - 0.05 AS x, l_tax - 0.04 AS y, l_quantity - 25 AS s FROM lineitem),
m AS (SELECT k, sum(x * s) AS a, sum(y * s) AS b, count(*) AS n FROM h GROUP BY k),
f AS (SELECT k, n, CASE WHEN n >= 50 THEN a / sqrt(a * a + b * b) END AS fx, CASE WHEN n >= 50 THEN b / sqrt(a * a + b * b) END AS fy FROM m),
c AS (SELECT k, corr(x * fx + y * fy, s) AS r FROM h JOIN f USING (k) WHERE fx IS NOT NULL GROUP BY k)
SELECT k, n, (round(fx, 6) + 0.0) AS forward_x, (round(fy, 6) + 0.0) AS forward_y, (round(r, 6) + 0.0) AS correlation FROM f LEFT JOIN c USING (k)""")
def direction_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_discount") - 0.05).alias("h_x"), (F.col("l_tax") - 0.04).alias("h_y"), F.lit(0.0).alias("h_z"), (F.col("l_quantity") - 25).alias("s"))
    return rounded(frames.direction_fit(rows, "k", "h", "s").select("k", "n", "forward_x", "forward_y", "correlation"), "forward_x", "forward_y", "correlation")


def _vectors(spark: SparkSession, d: str, scale: float = 1.0) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", "label", *[(e[i].cast("double") * scale).alias(f"v_{a}") for i, a in enumerate("xyz")])


_V = "v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


@query(f"""WITH {_V}, m AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM v GROUP BY label),
u AS (SELECT label, n, -x / sqrt(x * x + y * y + z * z) AS dx, -y / sqrt(x * x + y * y + z * z) AS dy, -z / sqrt(x * x + y * y + z * z) AS dz FROM m),
s AS (SELECT label, sqrt(avg(acos(greatest(-1, least(1, -(x * dx + y * dy + z * dz) / sqrt(x * x + y * y + z * z)))) ** 2)) AS sp, avg(sqrt(x * x + y * y + z * z)) - 9.80665 AS me FROM v JOIN u USING (label) GROUP BY label)
SELECT label, n, {rs('dx')} AS down_x, {rs('dy')} AS down_y, {rs('dz')} AS down_z, {rs('sp')} AS spread_rad, {rs('me')} AS magnitude_error,
  {rs('CASE WHEN n >= 20 THEN greatest(0, least(1, 1 - sp / 0.35)) * greatest(0, least(1, 1 - abs(me) / (0.2 * 9.80665))) * (0.5 + 0.5 * greatest(0, least(1, n / 200.0))) ELSE 0 END')} AS confidence FROM u JOIN s USING (label)""")
def mean_direction_spread(spark: SparkSession, d: str) -> DataFrame:
    out = frames.gravity_direction(_vectors(spark, d), "label", "v")
    return rounded(out, "down_x", "down_y", "down_z", "spread_rad", "magnitude_error", "confidence")


@query(f"""WITH {_V}, n AS (SELECT vec_id, sqrt(x * x + y * y + z * z) AS n FROM v)
SELECT vec_id, {rs('n')} AS norm, abs(n - 9.80665) <= 0.5 AS low_dynamic, n <= 1.5 AS plausible FROM n""")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = V.vector("v")
    return _vectors(spark, d).select("vec_id", r(V.norm(v)).alias("norm"), V.low_dynamic(v).alias("low_dynamic"), V.plausible(v, 1.5).alias("plausible"))


@query(f"""WITH {_V}, n AS (SELECT *, sqrt(x * x + y * y + z * z) * 25 AS n, vec_id * 1000000 AS t, sqrt(x * x + y * y + z * z) AS l FROM v),
w AS (SELECT *, lag(x / l) OVER o AS px, lag(y / l) OVER o AS py, lag(z / l) OVER o AS pz, (t - lag(t) OVER o) / 1000000.0::DOUBLE AS dt FROM n WINDOW o AS (PARTITION BY label ORDER BY vec_id)),
q AS (SELECT *, acos(greatest(-1, least(1, (x * px + y * py + z * pz) / l))) / dt AS rate, degrees(acos(greatest(-1, least(1, z / l)))) AS dip FROM w),
a AS (SELECT label, count(*) AS n, avg((n BETWEEN 25 AND 65)::INTEGER) AS good, stddev_pop(n) / avg(n) AS cv, median(n) AS med, max(rate) AS p95, quantile_cont(dip, 0.95) - quantile_cont(dip, 0.05) AS dips FROM q GROUP BY label),
i AS (SELECT *, ((good < 0.8)::INTEGER * 1 + (coalesce(p95, 0) > 3)::INTEGER * 2 + (cv > 0.15)::INTEGER * 4 + (dips > 15)::INTEGER * 8 + (n < 2)::INTEGER * 16)::INTEGER AS issues FROM a)
SELECT label, n, {rs('good')} AS good_fraction, {rs('cv')} AS cv, {rs('med')} AS median_ut, {rs('p95', 5)} AS rate_max, {rs('dips', 4)} AS dip_range_deg, issues,
  {rs('CASE WHEN issues >= 16 OR NOT med BETWEEN 12.5 AND 130 OR bit_count(issues) >= 2 THEN 0 WHEN bit_count(issues) = 1 THEN 0.3 ELSE good * greatest(0, least(1, 1 - cv / 0.15)) END')} AS weight FROM i""")
def field_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d, 25.0).withColumn("t", F.col("vec_id") * 1_000_000).select("*", F.lit(0.0).alias("down_x"), F.lit(0.0).alias("down_y"), F.lit(1.0).alias("down_z"))
    out = rounded(frames.magnetometer(rows, "label", ["vec_id"], "t", "v", "down"), "good_fraction", "cv", "median_ut", "weight")
    return out.withColumn("rate_max", r("rate_max", 5)).withColumn("dip_range_deg", r("dip_range_deg", 4))


@query("""SELECT l_suppkey AS k, CASE WHEN count(*) >= 3 THEN round(atan2(sum(l_quantity * l_tax - l_discount * l_extendedprice / 1000), sum(l_quantity * l_extendedprice / 1000 + l_discount * l_tax)), 6) + 0.0 END AS yaw_rad
FROM lineitem GROUP BY l_suppkey""")
def yaw_offset(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("k")).agg(r(frames.yaw_offset(c("l_quantity"), c("l_discount"), c("l_extendedprice") / 1000, c("l_tax"))).alias("yaw_rad"))


@query("""WITH m AS (SELECT o_custkey % 50 AS k, o_orderkey, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS e FROM orders)
SELECT k, (round(sqrt(avg(e * e)), 4) + 0.0) AS rmse, (round(avg(e), 4) + 0.0) AS mean, (round(max(abs(e)), 4) + 0.0) AS max_abs, (round(arg_max(e, o_orderkey), 4) + 0.0) AS final, count(e) AS n FROM m GROUP BY k""")
def error_summary(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("k").orderBy("o_orderkey").rowsBetween(-4, 0)
    rows = table(spark, d, "orders").withColumn("k", F.col("o_custkey") % 50)
    rows = rows.withColumn("e", F.col("o_totalprice") - F.avg("o_totalprice").over(w))
    return rounded(frames.error_summary(rows, "k", "e", ["o_orderkey"]), "rmse", "mean", "max_abs", "final", digits=4)


@query(f"""WITH {E_SQL}, a AS (SELECT k, arg_max(x, t) AS f, (max(t) - min(t)) / 1000000.0::DOUBLE AS d, sum(x) AS s FROM e GROUP BY k)
SELECT k, {rs('f / d', 9)} AS per_second, {rs('2 * f / (d * d)', 12)} AS as_acceleration, {rs('CASE WHEN s > 1 THEN f / s END', 9)} AS per_distance FROM a""")
def drift_metrics(spark: SparkSession, d: str) -> DataFrame:
    a = events(spark, d).groupBy("k").agg(F.max_by("x", "t").alias("f"), ((F.max("t") - F.min("t")) / 1e6).alias("d"), F.sum("x").alias("s"))
    m = frames.drift(F.col("f"), F.col("d"), F.col("s"))
    return a.select("k", r(m["per_second"], 9).alias("per_second"), r(m["as_acceleration"], 12).alias("as_acceleration"), r(m["per_distance"], 9).alias("per_distance"))


@query(f"""WITH {E_SQL}, m AS (SELECT *, coalesce(x < 60, false) AS calm, CASE WHEN event_id % 11 > 0 THEN (x - 30) / 1000 END AS gx, (event_id % 5 - 2) / 1000.0::DOUBLE AS gy, 0.6::DOUBLE * (9.8 + x % 1) AS ax, CASE WHEN event_id % 13 > 0 THEN 0.8::DOUBLE * (9.8 + x % 1) END AS az FROM e),
w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) - row_number() OVER (PARTITION BY k, calm ORDER BY t, event_id) AS g FROM m),
s AS (SELECT k, min(t) AS a, max(t) AS b FROM w WHERE calm GROUP BY k, g), l AS (SELECT k, a, b FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b - a DESC, a) AS rk FROM s) WHERE rk = 1),
n AS (SELECT m.k, count(az) AS na, avg(ax) FILTER (az IS NOT NULL) * 0.6 + avg(az) * 0.8 - 9.80665 AS off, count(gx) AS ng, avg(gx) AS x, avg(gy) FILTER (gx IS NOT NULL) AS y, stddev_samp(gx) AS sx FROM m JOIN l ON l.k = m.k AND m.t BETWEEN l.a AND l.b WHERE calm GROUP BY m.k)
SELECT u.k, coalesce(na, 0) AS rest_samples, {rs('CASE WHEN ng > 0 AND sqrt(x * x + y * y + 0.0001) <= 0.35 THEN x ELSE 0 END', 9)} AS gyro_bias_x, {rs('CASE WHEN ng > 0 AND sqrt(x * x + y * y + 0.0001) <= 0.35 THEN y ELSE 0 END', 9)} AS gyro_bias_y, {rs('sx', 9)} AS gyro_sigma_x,
  {rs('CASE WHEN na >= 2 AND abs(off) <= 2 THEN 0.6 * off ELSE 0 END')} AS accel_bias_x, {rs('CASE WHEN na >= 2 AND abs(off) <= 2 THEN 0.8 * off ELSE 0 END')} AS accel_bias_z FROM (SELECT DISTINCT k FROM e) u LEFT JOIN n USING (k)""")
def bias_from_rest(spark: SparkSession, d: str) -> DataFrame:
    """Biases from every user's longest rest, the vertical being given."""
    e, size = events(spark, d), 9.8 + F.col("x") % 1
    rows = e.select(
        "k", "t", "event_id", F.coalesce(F.col("x") < 60, F.lit(False)).alias("rest"), F.when(F.col("event_id") % 11 > 0, (F.col("x") - 30) / 1000).alias("g_x"), ((F.col("event_id") % 5 - 2) / 1000.0).alias("g_y"), F.lit(0.01).alias("g_z"),
        (size * 0.6).alias("a_x"), F.lit(0.0).alias("a_y"), F.when(F.col("event_id") % 13 > 0, size * 0.8).alias("a_z"), F.lit(0.6).alias("u_x"), F.lit(0.0).alias("u_y"), F.lit(0.8).alias("u_z"),
    )
    out = navigation.bias_from_longest_rest(rows, "k", ["event_id"], "t", "rest", "a", "u", "g")
    out = rounded(out, "gyro_bias_x", "gyro_bias_y", "gyro_sigma_x", digits=9)
    return rounded(out.select("k", "rest_samples", "gyro_bias_x", "gyro_bias_y", "gyro_sigma_x", "accel_bias_x", "accel_bias_z"), "accel_bias_x", "accel_bias_z")


@query(f"""WITH {E_SQL}, b AS (SELECT k, CASE WHEN event_type = 'view' THEN x END AS p, CASE WHEN event_type <> 'error' THEN x * 2 END AS f, event_id FROM e),
s AS (SELECT k, avg((p IS NOT NULL)::INTEGER) AS ps, avg((f IS NOT NULL)::INTEGER) AS fs FROM b GROUP BY k)
SELECT event_id, CASE WHEN ps > 0.2 THEN 'p' WHEN fs > 0.2 THEN 'f' END AS speed_source, CASE WHEN ps > 0.2 THEN p WHEN fs > 0.2 THEN f END AS speed FROM b JOIN s USING (k)""")
def choose_speed(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("p", F.when(F.col("event_type") == "view", F.col("x"))).withColumn("f", F.when(F.col("event_type") != "error", F.col("x") * 2))
    return frames.choose_speed(rows, "k", "p", "f", 0.2).select("event_id", "speed_source", "speed")


@query("SELECT digest, n, ids FROM (SELECT sha256(text) AS digest, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents WHERE text IS NOT NULL GROUP BY 1) WHERE n > 1")
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id")
    return splits.duplicate_groups(docs, "digest", "doc_id").select("digest", "n", F.array_join(F.transform("paths", lambda p: p.cast("string")), ",").alias("ids"))


@query("SELECT min(doc_id) AS path FROM documents GROUP BY coalesce(sha256(text), 'path:' || doc_id)")
def canonical_copies(spark: SparkSession, d: str) -> DataFrame:
    return splits.canonical_paths(table(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id"), "digest", "doc_id")


@query("SELECT doc_id, CASE WHEN text IS NOT NULL THEN sha256(CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END) END AS payload FROM documents")
def payload_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), splits.payload_digest(F.col("text"))).alias("payload"))


@query("""WITH RECURSIVE g AS (SELECT DISTINCT 't' || md5(text) AS a, 'l' || md5(split_part(text, chr(10), 1)) AS b FROM documents WHERE text IS NOT NULL),
e AS (SELECT a AS u, b AS v FROM g UNION SELECT b, a FROM g),
w(node, reach) AS (SELECT u, u FROM e UNION SELECT w.node, e.v FROM w JOIN e ON e.u = w.reach)
SELECT node, min(reach) AS component FROM w GROUP BY node""")
def group_closure(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring_index("text", "\n", 1)
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    edges = docs.select(F.concat(F.lit("t"), F.md5(F.col("text").cast("binary"))).alias("a"), F.concat(F.lit("l"), F.md5(first.cast("binary"))).alias("b"))
    return splits.closure(edges, "a", "b")


@query("""WITH RECURSIVE g AS (SELECT c_nationkey::VARCHAR AS key, count(*) AS n FROM customer GROUP BY 1),
o AS (SELECT key, n, row_number() OVER (ORDER BY n DESC, (('0x' || substr(sha256('tracewright:' || key), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE, key) AS i, sum(n) OVER () AS total FROM g),
p AS (
  SELECT 0::BIGINT AS i, ''::VARCHAR AS key, ''::VARCHAR AS split, (SELECT max(total) FROM o) * 0.15::DOUBLE AS te, (SELECT max(total) FROM o) * 0.7::DOUBLE AS tr, (SELECT max(total) FROM o) * 0.15::DOUBLE AS va
  UNION ALL
  SELECT o.i, o.key, CASE WHEN te >= tr AND te >= va THEN 'test' WHEN tr >= va THEN 'train' ELSE 'validation' END,
    te - CASE WHEN te >= tr AND te >= va THEN n ELSE 0 END, tr - CASE WHEN NOT (te >= tr AND te >= va) AND tr >= va THEN n ELSE 0 END, va - CASE WHEN NOT (te >= tr AND te >= va) AND NOT tr >= va THEN n ELSE 0 END
  FROM p JOIN o ON o.i = p.i + 1)
SELECT key, split FROM p WHERE i > 0""")
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("key")).agg(F.count("*").alias("n"))
    return splits.pack(groups, "key", "n")


@query("""WITH a AS (SELECT sha256(text) AS h, source, lang, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM documents),
k AS (SELECT 'payload' AS kind, h AS key, split FROM a WHERE h IS NOT NULL UNION ALL SELECT 'session', source || '|' || lang, split FROM a)
SELECT kind, key, splits FROM (SELECT kind, key, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) AS n FROM k GROUP BY kind, key) WHERE n > 1""")
def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id") % 3
    a = table(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "source", "lang", F.when(i == 0, "train").when(i == 1, "validation").otherwise("test").alias("split"))
    return splits.leakage(a, {"payload": ["h"], "session": ["source", "lang"]})


@query("""SELECT sha256(text) AS fingerprint, count(*) AS n, count(DISTINCT doc_id % 3)::INTEGER AS n_splits, count(DISTINCT doc_id % 3) > 1 AS violation FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def content_audit(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("fingerprint"), (F.col("doc_id") % 3).alias("split"))
    return splits.content_audit(a)


@query(f"""WITH {E_SQL}, h AS (SELECT k, t, event_id, sha256(printf('%.6f', round(event_id / 8.0::DOUBLE, 6)) || ',' || printf('%.6f', round(x, 6))) AS h FROM e),
i AS (SELECT k, h, row_number() OVER (PARTITION BY k ORDER BY t, event_id) - 1 AS i FROM h),
b AS (SELECT k, i // 4096 AS b, sha256(string_agg(h, '' ORDER BY i)) AS h, count(*) AS n FROM i GROUP BY k, i // 4096),
c AS (SELECT k, b // 4096 AS c, sha256(string_agg(h, '' ORDER BY b)) AS h, sum(n) AS n FROM b GROUP BY k, b // 4096)
SELECT k, sum(n)::BIGINT AS n, sha256(sum(n)::BIGINT::VARCHAR || '|w,x|' || string_agg(h, '' ORDER BY c)) AS fingerprint FROM c GROUP BY k""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return splits.fingerprint(events(spark, d).withColumn("w", F.col("event_id") / 8.0), ["k"], ["t", "event_id"], ["x", "w"])


@query("""WITH f AS (SELECT split_part(url, '://', 2) AS p, CASE WHEN page_id % 2 = 0 THEN 'S-' ELSE 'v-' END || 'run' || (page_id % 60) || '.csv' AS name, page_id FROM pages),
s AS (SELECT upper(regexp_extract(name, '^[SsVv]-(.+)\\.csv$', 1)) AS session, CASE WHEN upper(name) LIKE 'S-%' THEN 'smartphone' ELSE 'vehicle' END AS stream, lpad(page_id::VARCHAR, 9, '0') AS path FROM f)
SELECT session, string_agg(path, ',' ORDER BY path) FILTER (stream = 'smartphone') AS phones, min(path) FILTER (stream = 'vehicle') AS first_vehicle,
  count(*) FILTER (stream = 'smartphone') > 0 AND count(*) FILTER (stream = 'vehicle') > 0 AS paired FROM s GROUP BY session""")
def sessions_pairing(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(F.col("page_id") % 2 == 0, "S-").otherwise("v-"), F.lit("run"), (F.col("page_id") % 60).cast("string"), F.lit(".csv"))
    stream, session = TX.stream_and_session(name)
    files = table(spark, d, "pages").select(stream.alias("stream"), session.alias("session"), F.lpad(F.col("page_id").cast("string"), 9, "0").alias("path"))
    out = splits.pair_streams(files, ["session"], "stream", "path")
    return out.select("session", F.nullif(F.array_join("smartphone", ","), F.lit("")).alias("phones"), "first_vehicle", "paired")


@query("""SELECT p_partkey, CASE WHEN h LIKE '%GPS LATITUDE%' THEN 'gnss_latitude' WHEN h LIKE '%TIME SINCE START OF DAY%' THEN 'time_of_day_s' WHEN h LIKE '%TIME SINCE START%' THEN 'time_since_start_ms' WHEN h LIKE '%LATITUDE%' THEN 'gnss_latitude' WHEN h LIKE '%GEAR%' THEN 'gear' ELSE 'unknown' END AS role
FROM (SELECT p_partkey, upper(trim(regexp_replace(CASE p_partkey % 5 WHEN 0 THEN ' gps  latitude (deg)' WHEN 1 THEN 'Time since start of  day' WHEN 2 THEN 'time since start (ms)' WHEN 3 THEN 'Latitude' ELSE p_name || ' gear' END, '\\s+', ' ', 'g'))) AS h FROM part)""")
def role_mapping(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey") % 5
    header = F.when(i == 0, " gps  latitude (deg)").when(i == 1, "Time since start of  day").when(i == 2, "time since start (ms)").when(i == 3, "Latitude").otherwise(F.concat("p_name", F.lit(" gear")))
    return table(spark, d, "part").select("p_partkey", TX.role(header).alias("role"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '  ' || p_name || ' (m/s) ' WHEN 1 THEN p_name ELSE '(deg)' END AS raw FROM part)
SELECT p_partkey, nullif(trim(regexp_extract(raw, '\\(([^)]*)\\)\\s*$', 1)), '') AS unit, coalesce(nullif(trim(regexp_replace(trim(raw), '\\([^)]*\\)\\s*$', '')), ''), trim(raw)) AS name, upper(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS normal FROM n""")
def unit_strip(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey") % 3
    raw = F.when(i == 0, F.concat(F.lit("  "), "p_name", F.lit(" (m/s) "))).when(i == 1, F.col("p_name")).otherwise("(deg)")
    return table(spark, d, "part").select("p_partkey", TX.unit_of(raw).alias("unit"), TX.without_unit(raw).alias("name"), TX.normalized(raw).alias("normal"))


@query("""WITH n AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 30) || ' / ' || (event_id % 30 + 2) WHEN 1 THEN (event_id % 12)::VARCHAR || '.0' WHEN 2 THEN 'none' END AS raw FROM events)
SELECT event_id, coalesce(nullif(regexp_extract(raw, '^\\s*(\\d+)\\s*/\\s*(\\d+)\\s*$', 1), '')::DOUBLE, try_cast(raw AS DOUBLE)) AS in_use, nullif(regexp_extract(raw, '^\\s*(\\d+)\\s*/\\s*(\\d+)\\s*$', 2), '')::DOUBLE AS in_view FROM n""")
def ratio_parse(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.concat((i % 30).cast("string"), F.lit(" / "), (i % 30 + 2).cast("string"))).when(i % 4 == 1, F.concat((i % 12).cast("string"), F.lit(".0"))).when(i % 4 == 2, "none")
    a, b = TX.ratio(raw)
    return table(spark, d, "events").select("event_id", a.alias("in_use"), b.alias("in_view"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL ELSE hour(ts) * 3600.0::DOUBLE + minute(ts) * 60 + floor(second(ts)) + CASE event_id % 3 WHEN 1 THEN (millisecond(ts) % 1000) / 1000.0::DOUBLE ELSE 0 END END AS seconds FROM events""")
def colon_millis_ts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id") % 3
    raw = F.when(i == 0, F.date_format("ts", "yyyy-MM-dd")).when(i == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss:SSS")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", TX.colon_millis(raw)[0].alias("seconds"))


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rk FROM lineitem) WHERE rk <= 10""")
def topk_per_class(spark: SparkSession, d: str) -> DataFrame:
    out = splits.top_per(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey", k=10)
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH a AS (SELECT l_suppkey, sum(l_extendedprice) AS d FROM lineitem GROUP BY 1), m AS (SELECT median(d) AS m FROM a)
SELECT l_suppkey FROM a, m ORDER BY round(abs(d - m), 4), l_suppkey LIMIT 12""")
def closest_to_median(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("d"))
    return splits.closest_to_median(a, "d", 12, "l_suppkey").select("l_suppkey")


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders GROUP BY o_orderpriority")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.percentiles(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]), "p25", "p50", "p75", digits=4)


@query(f"WITH {E_SQL} SELECT CASE WHEN x >= 0 AND x < 3 THEN '[0,3)' WHEN x >= 3 AND x < 15 THEN '[3,15)' WHEN x >= 15 AND x < 40 THEN '[15,40)' WHEN x >= 40 AND x < 5000 THEN '[40,5000)' WHEN x IS NULL THEN 'unknown' ELSE 'other' END AS bucket, count(*) AS n FROM e GROUP BY 1")
def rate_buckets(spark: SparkSession, d: str) -> DataFrame:
    return quality.value_counts(events(spark, d).select(quality.rate_bucket(F.col("x")).alias("bucket")), "bucket")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 7 >= n_nationkey % 5 AND n_nationkey % 5 > 0 OR n_nationkey % 11 > 8 THEN 'FAIL' WHEN n_nationkey % 7 > 0 OR n_nationkey % 3 > 0 OR n_nationkey % 2 > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM nation""")
def integrity_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    other = F.when(k % 11 > 8, 1).otherwise(0)
    return table(spark, d, "nation").select("n_nationkey", quality.integrity(k % 5, k % 7, other, k % 3, k % 2)[0].alias("status"))


@query(f"""WITH {E_SQL}, a AS (SELECT k, corr(x, event_id) AS c, count(*) AS n, stddev_pop(x) / 200 AS sd FROM e GROUP BY k)
SELECT k, {rs('greatest(0, least(1, (c - 0.3) / (1.0 - 0.3))) * (0.4 + 0.6 * greatest(0, least(1, n / 250.0))) * (0.3 + 0.7 * greatest(0, least(1, 1 - 0.1 / 0.26)))')} AS forward,
  {rs('coalesce((greatest(0, least(1, 1 - sd / 0.25)) + greatest(0, least(1, 1 - abs(c) / 10 / 0.03))) / 2, greatest(0, least(1, 1 - sd / 0.25)))')} AS rest, {rs('greatest(0, 1 - n / 100.0)')} AS residual FROM a""")
def confidences(spark: SparkSession, d: str) -> DataFrame:
    a = events(spark, d).groupBy("k").agg(F.corr("x", "event_id").alias("c"), F.count("*").alias("n"), (F.stddev_pop("x") / 200).alias("sd"))
    return a.select(
        "k", r(frames.forward_confidence(F.col("c"), F.col("n"), F.lit(0.1))).alias("forward"), r(frames.rest_confidence(F.col("sd"), F.abs("c") / 10)).alias("rest"), r(frames.residual_factor(F.col("n") / 10.0)).alias("residual")
    )


@query(f"""WITH {E_SQL}, t AS (SELECT k, t, event_id, 9.80665 + (x - 20) / 50 AS f, (event_id % 4) / 200.0::DOUBLE AS g FROM e),
w AS (SELECT event_id, count(f) OVER o AS n, stddev_pop(f) OVER o AS s, avg(f) OVER o AS m, avg(g) OVER o AS gm FROM t WINDOW o AS (PARTITION BY k ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
SELECT event_id, coalesce(n >= 2 AND s <= 0.25 AND abs(m - 9.80665) <= 0.15 AND gm <= 0.03, false) AS stationary FROM w""")
def stationarity(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("f", 9.80665 + (F.col("x") - 20) / 50).withColumn("g", (F.col("event_id") % 4) / 200.0)
    return ordered.stationary(rows, "k", ["event_id"], "t", "f", "g", 86400.0).select("event_id", "stationary")
