"""Queries with recurrences and lag searches over recordings made of events; SQL walks their samples one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..operators import alignment, attitude, lags, navigation, propagation, scans
from .common import E_SQL, events, micros, r, rounded, rs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _stage(source: str, **columns: str) -> str:
    """A subquery that adds columns, so that each step of a formula is computed once."""
    return f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source})"


def _turned(source: str, q: str, v: str, out: str) -> str:
    """Adds out_x, _y, _z: the vector columns v turned by the quaternion columns q."""
    x, y, z = (f"{v}{c}" for c in "xyz")
    source = _stage(source, **{f"{out}tx": f"2*({q}y*{z}-{q}z*{y})", f"{out}ty": f"2*({q}z*{x}-{q}x*{z})", f"{out}tz": f"2*({q}x*{y}-{q}y*{x})"})
    a = f"{out}t"
    return _stage(source, **{f"{out}x": f"{x}+{q}w*{a}x+{q}y*{a}z-{q}z*{a}y", f"{out}y": f"{y}+{q}w*{a}y+{q}z*{a}x-{q}x*{a}z", f"{out}z": f"{z}+{q}w*{a}z+{q}x*{a}y-{q}y*{a}x"})


def _product(source: str, a: str, b: str, out: str) -> str:
    """Adds the unit quaternion a b."""
    source = _stage(source, **{
        f"{out}rx": f"{a}w*{b}x+{b}w*{a}x+{a}y*{b}z-{a}z*{b}y", f"{out}ry": f"{a}w*{b}y+{b}w*{a}y+{a}z*{b}x-{a}x*{b}z",
        f"{out}rz": f"{a}w*{b}z+{b}w*{a}z+{a}x*{b}y-{a}y*{b}x", f"{out}rw": f"{a}w*{b}w-{a}x*{b}x-{a}y*{b}y-{a}z*{b}z",
    })
    source = _stage(source, **{f"{out}n": f"sqrt({'+'.join(f'{out}r{c}*{out}r{c}' for c in 'xyzw')})"})
    return _stage(source, **{f"{out}{c}": f"{out}r{c}/{out}n" for c in "xyzw"})


def _spin(source: str, v: str, out: str) -> str:
    """Adds the quaternion of the rotation vector v."""
    source = _stage(source, **{f"{out}a": f"sqrt({'+'.join(f'{v}{c}*{v}{c}' for c in 'xyz')})"})
    source = _stage(source, **{f"{out}k": f"CASE WHEN {out}a < 1e-12 THEN 0.5 ELSE sin({out}a/2)/{out}a END"})
    return _stage(source, **{f"{out}{c}": f"{v}{c}*{out}k" for c in "xyz"}, **{f"{out}w": f"cos({out}a/2)"})


STATE = ("k", "i", "c", "t", *[f"q{a}" for a in "xyzw"], *[f"v{a}" for a in "xyz"], *[f"p{a}" for a in "xyz"], *[f"a{a}" for a in "xyz"], "flags")
MEASURED_SQL = """r AS MATERIALIZED (SELECT k, i, i * 0.1::DOUBLE + CASE WHEN i >= 30 THEN 2.0::DOUBLE ELSE 0 END AS t, CASE WHEN event_id % 41 > 0 THEN x / 100 END AS fx, (event_id % 9 - 4) / 10.0::DOUBLE AS fy, 9.80665::DOUBLE AS fz,
  (event_id % 7 - 3) / 10.0::DOUBLE AS wx, (event_id % 5 - 2) / 8.0::DOUBLE AS wy, (event_id % 11 - 5) / 20.0::DOUBLE AS wz FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) - 1 AS i FROM e))"""


def _strapdown(cases: str) -> str:
    """m: the states of each recording and case (c, bias of the rates bw, bias of the forces bf), step by step."""
    s = f"""(SELECT r.k, r.i, m.c, r.t, r.t - m.t AS dt, CASE WHEN r.t - m.t > 0.5 THEN 16 WHEN r.fx IS NULL THEN 32 ELSE 0 END AS fl, {', '.join(f'r.w{a} - b.bw{a} AS w{a}, r.f{a} - b.bf{a} AS f{a}, m.v{a}, m.p{a}, m.a{a}' for a in 'xyz')}, m.qx, m.qy, m.qz, m.qw
      FROM m JOIN r ON r.k = m.k AND r.i = m.i + 1 JOIN ({cases}) b ON b.c = m.c)"""
    s = _product(_spin(_stage(s, **{f"s{a}": f"w{a}*dt" for a in "xyz"}), "s", "d"), "q", "d", "h")
    s = _stage(s, **{f"u{a}": f"CASE WHEN fl = 0 THEN h{a} ELSE q{a} END" for a in "xyzw"})
    s = _stage(_turned(s, "u", "f", "g"), nx="gx", ny="gy", nz="gz - 9.80665")
    s = _stage(s, **{f"e{a}": f"CASE WHEN fl = 0 THEN 0.5*(coalesce(a{a}, n{a}) + n{a})*dt ELSE 0 END" for a in "xyz"})
    step = f"SELECT k, i, c, t, ux, uy, uz, uw, {', '.join(f'v{a} + e{a}' for a in 'xyz')}, {', '.join(f'p{a} + CASE WHEN fl = 0 THEN (v{a} + 0.5*e{a})*dt ELSE 0 END' for a in 'xyz')}, {', '.join(f'CASE WHEN fl = 0 THEN n{a} END' for a in 'xyz')}, fl FROM {s}"
    zero = ", ".join(["0.0::DOUBLE"] * 3)
    return f"m({', '.join(STATE)}) AS (SELECT k, i, c, t, {zero}, 1.0::DOUBLE, {zero}, {zero}, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0 FROM r, ({cases}) WHERE i = 0 UNION ALL {step})"


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Each user as a recording of ten rows a second, with turns, a gap after three seconds and samples that a sensor lost."""
    w = W.partitionBy("k").orderBy("t", "event_id")
    rows = events(spark, d).withColumn("i", F.row_number().over(w) - 1)
    axes = {"force_x": F.when(F.col("event_id") % 41 > 0, F.col("x") / 100), "force_y": (F.col("event_id") % 9 - 4) / 10.0, "force_z": F.lit(9.80665)}
    axes |= {"gyro_x": (F.col("event_id") % 7 - 3) / 10.0, "gyro_y": (F.col("event_id") % 5 - 2) / 8.0, "gyro_z": (F.col("event_id") % 11 - 5) / 20.0}
    return rows.select("k", "i", (F.col("i") * 0.1 + F.when(F.col("i") >= 30, 2.0).otherwise(0.0)).alias("t_s"), *[c.alias(n) for n, c in axes.items()])


_NO_BIAS = "SELECT 0 AS c, " + ", ".join(f"0.0::DOUBLE AS b{s}{a}" for s in "wf" for a in "xyz")


@query(f"""WITH RECURSIVE {E_SQL}, {MEASURED_SQL}, {_strapdown(_NO_BIAS)}
SELECT k, i, {', '.join(f"{rs(f'v{a}')} AS v_{a}, {rs(f'p{a}')} AS p_{a}" for a in 'xyz')}, {', '.join(f"{rs(f'q{a}')} AS q_{a}" for a in 'xyzw')}, flags FROM m""")
def gyro_mechanize(spark: SparkSession, d: str) -> DataFrame:
    """Strapdown propagation of every user's recording with its gyroscope, in blocks of a second; SQL walks the samples one after the other."""
    out = propagation.mechanize(measured(spark, d), "k", ["i"], block_s=1.0)
    names = [*[f"{p}_{a}" for p in "vp" for a in "xyz"], *[f"q_{a}" for a in "xyzw"]]
    return rounded(out.select("k", "i", *names, "flags"), *names)


def driven(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Each event type as a recording of ten rows a second, with more columns of events: speed from the values, the acceleration 0.6 s ahead of it along a tilted phone's axes, and for two of the types a gravity channel."""
    w = W.partitionBy("event_type").orderBy("t", "event_id")
    rows = events(spark, d).withColumns({"i": F.row_number().over(w) - 1, "f": F.coalesce((F.lead("x", 7).over(w) - F.lead("x", 5).over(w)) / 10, F.lit(0.0)), "l": (F.col("event_id") % 13 - 6) / 4.0, "d": (F.col("event_id") % 7 - 3) / 100.0})
    along = {"accel_x": (0.8, 0.6, 0.0), "accel_y": (-0.48, 0.64, 0.6), "accel_z": (0.36, -0.48, 0.8)}
    channel = F.col("event_type").isin("click", "view")
    felt = {"gravity_x": F.col("d"), "gravity_y": F.lit(9.80665 * 0.6), "gravity_z": F.lit(9.80665 * 0.8)}
    return rows.select(
        F.col("event_type").alias("k"), "i", (F.col("i").cast("long") * 100_000).alias("t"), (5 + F.col("x") / 10).alias("speed"), *more,
        *[(F.col("f") * a + F.col("l") * b + 9.80665 * c).alias(n) for n, (a, b, c) in along.items()], *[F.when(channel, c).alias(n) for n, c in felt.items()],
    )


ALIGNED_SQL = f"""{E_SQL},
b AS (SELECT event_type AS k, row_number() OVER w - 1 AS i, 5 + x / 10 AS v, coalesce((lead(x, 7) OVER w - lead(x, 5) OVER w) / 10, 0) AS f, (event_id % 13 - 6) / 4.0::DOUBLE AS l, (event_id % 7 - 3) / 100.0::DOUBLE AS d,
  event_type IN ('click', 'view') AS ch FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
a AS (SELECT *, 0.8::DOUBLE * f + 0.6::DOUBLE * l AS ax, -0.48::DOUBLE * f + 0.64::DOUBLE * l + 9.80665::DOUBLE * 0.6 AS ay, 0.36::DOUBLE * f - 0.48::DOUBLE * l + 9.80665::DOUBLE * 0.8 AS az FROM b),
o AS (SELECT k, ch, CASE WHEN ch THEN d ELSE ax END AS x, CASE WHEN ch THEN 9.80665::DOUBLE * 0.6 ELSE ay END AS y, CASE WHEN ch THEN 9.80665::DOUBLE * 0.8 ELSE az END AS z FROM a
  WHERE ch OR abs(sqrt(ax * ax + ay * ay + az * az) - 9.80665) <= 0.5),
g0 AS (SELECT k, any_value(ch) AS ch, count(*) AS gn, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM o GROUP BY k HAVING count(*) >= 20),
g1 AS (SELECT k, ch, gn, mx / m AS ux, my / m AS uy, mz / m AS uz FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS m FROM g0)),
g AS (SELECT k, ch, gn, ux, uy, uz, mag, greatest(0, least(1, 1 - sp / 0.35)) * greatest(0, least(1, 1 - abs(mag - 9.80665) / (0.2 * 9.80665))) * (0.5 + 0.5 * least(1, gn / 200.0::DOUBLE)) AS gc
  FROM (SELECT k, any_value(ch) AS ch, any_value(gn) AS gn, any_value(ux) AS ux, any_value(uy) AS uy, any_value(uz) AS uz, avg(n) AS mag, sqrt(avg(acos(greatest(-1, least(1, (x * ux + y * uy + z * uz) / n))) ** 2)) AS sp
    FROM (SELECT o.k, o.x, o.y, o.z, sqrt(x * x + y * y + z * z) AS n, g1.ch, g1.gn, ux, uy, uz FROM o JOIN g1 USING (k)) GROUP BY k)),
lin AS (SELECT a.k, i, v, ux, uy, uz, ax - ux * mag AS lx, ay - uy * mag AS ly, az - uz * mag AS lz, (lead(v) OVER w - lag(v) OVER w) / 0.2 AS s FROM a JOIN g USING (k) WHERE gc >= 0.2 WINDOW w AS (PARTITION BY a.k ORDER BY i)),
fl AS (SELECT *, lx - (lx * ux + ly * uy + lz * uz) * ux AS fx, ly - (lx * ux + ly * uy + lz * uz) * uy AS fy, lz - (lx * ux + ly * uy + lz * uz) * uz AS fz FROM lin),
sm AS MATERIALIZED (SELECT k, i, v, ux, uy, uz, avg(fx) OVER w AS hx, avg(fy) OVER w AS hy, avg(fz) OVER w AS hz, avg(s) OVER w AS s FROM fl WINDOW w AS (PARTITION BY k ORDER BY i RANGE BETWEEN 20 PRECEDING AND CURRENT ROW)),
p AS MATERIALIZED (SELECT sm.k, j, sm.i, sm.ux, sm.uy, sm.uz, sm.hx, sm.hy, sm.hz, q.s FROM sm, generate_series(-75, 75) x(j), sm q WHERE q.k = sm.k AND q.i = sm.i + 2 * j AND sm.v >= 2 AND abs(q.s) >= 0.4),
d0 AS (SELECT k, j, count(*) AS n, any_value(ux) AS ux, any_value(uy) AS uy, any_value(uz) AS uz, sum(hx * s) AS x, sum(hy * s) AS y, sum(hz * s) AS z FROM p GROUP BY k, j),
d1 AS (SELECT k, j, n, x - (x * ux + y * uy + z * uz) * ux AS x, y - (x * ux + y * uy + z * uz) * uy AS y, z - (x * ux + y * uy + z * uz) * uz AS z FROM d0),
d2 AS (SELECT k, j, n, CASE WHEN n >= 50 THEN x / sqrt(x * x + y * y + z * z) END AS x, CASE WHEN n >= 50 THEN y / sqrt(x * x + y * y + z * z) END AS y, CASE WHEN n >= 50 THEN z / sqrt(x * x + y * y + z * z) END AS z FROM d1),
c AS (SELECT p.k, p.j, any_value(n) AS n, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, CASE WHEN any_value(n) >= 50 THEN corr(hx * x + hy * y + hz * z, s) END AS r FROM p JOIN d2 USING (k, j) GROUP BY p.k, p.j),
t AS (SELECT k, max(r) AS top, arg_max(j, (r, -j)) FILTER (r IS NOT NULL) AS best, median(r) AS med FROM c GROUP BY k),
z AS (SELECT c.*, top - med AS margin FROM t JOIN c ON c.k = t.k AND c.j = CASE WHEN top - med >= 0.1 THEN best ELSE 0 END),
h AS (SELECT k, any_value(half) AS half, avg((sign(hx * x + hy * y + hz * z) <> sign(s))::INTEGER) AS rev, sum(hx * s) FILTER (rn <= half) AS ax, sum(hy * s) FILTER (rn <= half) AS ay, sum(hz * s) FILTER (rn <= half) AS az,
    sum(hx * s) FILTER (rn > half) AS cx, sum(hy * s) FILTER (rn > half) AS cy, sum(hz * s) FILTER (rn > half) AS cz
  FROM (SELECT p.*, z.x, z.y, z.z, row_number() OVER (PARTITION BY p.k ORDER BY p.i) AS rn, count(*) OVER (PARTITION BY p.k) // 2 AS half FROM p JOIN z USING (k, j)) GROUP BY k),
f AS (SELECT *, greatest(0, least(1, (r - 0.3) / 0.7)) * (0.4 + 0.6 * least(1, n / 250.0::DOUBLE)) * (0.3 + 0.7 * CASE WHEN dis IS NULL THEN 0.5 ELSE greatest(0, 1 - dis / 0.26) END) AS fc
  FROM (SELECT z.*, rev, CASE WHEN half >= 25 THEN acos(greatest(-1, least(1, (ax * cx + ay * cy + az * cz) / sqrt(ax * ax + ay * ay + az * az) / sqrt(cx * cx + cy * cy + cz * cz)))) END AS dis FROM z LEFT JOIN h USING (k))),
w AS (SELECT g.k, gn, CASE WHEN g.ch THEN 'gravity_channel' ELSE 'accel_low_dynamic' END AS gravity_method, gc, ux, uy, uz, coalesce(j, 0) * 0.2::DOUBLE AS lag_s, margin, n, r, x, y, z, dis, rev, coalesce(fc, 0) AS fc,
  CASE WHEN gc < 0.2 THEN 'LOW_GRAVITY_CONFIDENCE' WHEN coalesce(n, 0) < 50 THEN 'INSUFFICIENT_MOTION' WHEN fc > 0 THEN 'SUCCESS' ELSE 'LOW_HEADING_CONFIDENCE' END AS status FROM g LEFT JOIN f USING (k))"""


@query(f"""WITH {ALIGNED_SQL} SELECT k, status, gravity_method, gn AS gravity_n, {rs('gc')} AS gravity_confidence, {rs('fc')} AS forward_confidence, {rs('CASE WHEN fc > 0 THEN gc * fc ELSE 0 END')} AS confidence, {rs('lag_s')} AS lag_s, {rs('margin')} AS margin,
  n AS dynamic_n, {rs('r')} AS correlation, {rs('dis')} AS disagreement_rad, {rs('rev')} AS reversed_fraction, {rs('x')} AS forward_x, {rs('y')} AS forward_y, {rs('z')} AS forward_z, {rs('ux')} AS up_x, {rs('uy')} AS up_y, {rs('uz')} AS up_z FROM w""")
def alignment_fit(spark: SparkSession, d: str) -> DataFrame:
    """Mounting alignment of every event type's recording, its lag search spread over blocks of 30 seconds."""
    out = alignment.alignment(driven(spark, d), "k", "t", ["i"], gravity="gravity", block_s=30.0)
    m = F.col("rotation")
    out = out.select("*", *[m[j].alias(f"forward_{a}") for j, a in enumerate("xyz")], *[m[6 + j].alias(f"up_{a}") for j, a in enumerate("xyz")])
    names = ["gravity_confidence", "forward_confidence", "confidence", "lag_s", "margin", "correlation", "disagreement_rad", "reversed_fraction", *[f"{p}_{a}" for p in ("forward", "up") for a in "xyz"]]
    return rounded(out.select("k", "status", "gravity_method", "gravity_n", "dynamic_n", *names), *names)


@query(f"""WITH {ALIGNED_SQL}, n AS (SELECT event_type AS k, count(*) AS n FROM e GROUP BY 1)
SELECT k, CASE WHEN status = 'SUCCESS' AND short THEN 'LOW_HEADING_CONFIDENCE' ELSE status END AS status, n, gravity_method, {rs('CASE WHEN fc > 0 THEN gc * fc ELSE 0 END')} AS confidence, {rs('lag_s')} AS lag_s, {rs('r')} AS correlation,
  {', '.join(f"{rs(f'CASE WHEN NOT short THEN {a} END')} AS forward_{a}" for a in 'xyz')} FROM (SELECT w.* EXCLUDE (n), n.n, (n.n - 1) * 100000 < 20000000 AS short FROM w JOIN n USING (k))""")
def calibration_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same recordings as a stream of samples: sessions collect them trigger by trigger and end with a row that says so; the estimate of all their samples, however many, is the batch's."""
    from ..operators.store import Tables
    from ..streaming import calibration as C

    tables = Tables(spark, "calibration")
    rows = driven(spark, d).select("k", (F.col("t") / 1e6).alias("t_s"), "speed", *[f"{p}_{a}" for p in ("accel", "gravity") for a in "xyz"], F.lit(False).alias("finish"))
    at, out = f"{tables.folder}/in", f"{tables.folder}/out"
    rows.write.parquet(at)
    ends = spark.read.parquet(at).groupBy("k").agg(F.max("t_s").alias("t_s")).withColumn("finish", F.lit(True))
    rows.limit(0).unionByName(ends, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(at)  # newer than the samples' files, so read last
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.PROVIDER)
    try:
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(at)
        stream = C.collect(source, "k").writeStream.outputMode("update").option("checkpointLocation", f"{tables.folder}/checkpoint").trigger(availableNow=True)
        stream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/trigger={i}")).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    m = F.col("rotation")
    found = C.estimates(spark.read.parquet(out), "k", field=False, block_s=30.0).select("k", "status", "n", "gravity_method", "confidence", "lag_s", "correlation", *[m[j].alias(f"forward_{a}") for j, a in enumerate("xyz")])
    return rounded(found, "confidence", "lag_s", "correlation", *[f"forward_{a}" for a in "xyz"])


@query(f"""WITH {E_SQL}, b AS (SELECT event_type AS k, row_number() OVER w - 1 AS i, 5 + x / 10 AS v, 5 + lag(x, 8) OVER w / 10 + (event_id % 5) / 50.0::DOUBLE AS r FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
own AS (SELECT k, i, CASE WHEN lag(v) OVER w IS NULL THEN (lead(v) OVER w - v) / 0.1 WHEN lead(v) OVER w IS NULL THEN (v - lag(v) OVER w) / 0.1 ELSE (lead(v) OVER w - lag(v) OVER w) / 0.2 END AS g FROM b WINDOW w AS (PARTITION BY k ORDER BY i)),
a AS MATERIALIZED (SELECT k, i, avg(g) OVER (PARTITION BY k ORDER BY i RANGE BETWEEN 20 PRECEDING AND CURRENT ROW) AS a FROM own),
ref AS MATERIALIZED (SELECT k, i, r FROM b WHERE i % 3 = 0 AND r IS NOT NULL),
y AS (SELECT b.k, j, b.i, b.i + 2 * j AS y, (b.i + 2 * j) - ((b.i + 2 * j) % 3 + 3) % 3 AS lo FROM b, generate_series(-75, 75) x(j)),
q AS (SELECT y.k, y.j, y.i, CASE WHEN y.y = y.lo THEN p.r ELSE p.r + (n.r - p.r) * (y.y - y.lo) / 3.0::DOUBLE END AS v FROM y LEFT JOIN ref p ON p.k = y.k AND p.i = y.lo LEFT JOIN ref n ON n.k = y.k AND n.i = y.lo + 3),
o AS (SELECT k, j, i, CASE WHEN lag(v) OVER w IS NULL THEN (lead(v) OVER w - v) / 0.1 WHEN lead(v) OVER w IS NULL THEN (v - lag(v) OVER w) / 0.1 ELSE (lead(v) OVER w - lag(v) OVER w) / 0.2 END AS g FROM q WINDOW w AS (PARTITION BY k, j ORDER BY i)),
s AS (SELECT k, j, i, avg(g) OVER (PARTITION BY k, j ORDER BY i RANGE BETWEEN 20 PRECEDING AND CURRENT ROW) AS b FROM o),
c AS (SELECT k, j, CASE WHEN count(*) >= 10 THEN corr(a, b) END AS r FROM s JOIN a USING (k, i) WHERE b IS NOT NULL GROUP BY k, j),
t AS (SELECT k, max(r) AS top, arg_max(j, (r, -j)) FILTER (r IS NOT NULL) AS best, median(r) AS med, max(r) FILTER (j = 0) AS zero FROM c GROUP BY k),
u AS (SELECT *, top - med >= 0.1 AND top >= 0.3 AND abs(best) >= 1 AS ok FROM t)
SELECT k, {rs('CASE WHEN ok THEN best * 0.2 ELSE 0 END')} AS lag_s, {rs('CASE WHEN ok THEN top ELSE zero END')} AS correlation, {rs('zero')} AS zero_correlation, {rs('top - med')} AS margin, ok AS accepted, ok AND abs(best) >= 74 AS at_edge FROM u""")
def residual_lag(spark: SparkSession, d: str) -> DataFrame:
    """Each event type as a track of ten rows a second against a reference of every third row, 0.8 s late; blocks of 30 seconds."""
    w = W.partitionBy("event_type").orderBy("t", "event_id")
    rows = events(spark, d).withColumns({"i": F.row_number().over(w) - 1, "late": F.lag("x", 8).over(w)}).withColumnRenamed("event_type", "type")
    at = [F.col("type").alias("k"), (F.col("i").cast("long") * 100_000).alias("t")]
    track = rows.select(*at, (5 + F.col("x") / 10).alias("speed"))
    ref = rows.where("i % 3 = 0 AND late IS NOT NULL").select(*at, (5 + F.col("late") / 10 + (F.col("event_id") % 5) / 50.0).alias("speed"))
    return rounded(lags.residual_lag(track, ref, "k", "t", block_s=30.0), "lag_s", "correlation", "zero_correlation", "margin")


@query(f"""WITH {E_SQL}, {MEASURED_SQL}, s AS (SELECT r.*, event_id FROM r JOIN (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t, event_id) - 1 AS i, event_id FROM e) USING (k, i)),
d AS (SELECT *, t - lag(t) OVER w AS dt FROM s WINDOW w AS (PARTITION BY k ORDER BY i)),
md AS (SELECT k, median(round(dt * 1000000) / 1000000) FILTER (dt > 0) AS med FROM d GROUP BY k),
b AS (SELECT d.*, med, CASE WHEN i = 0 THEN 0 WHEN dt > 0.5 THEN 16 WHEN fx IS NULL THEN 32 ELSE 0 END AS bad, sin(event_id % 9 / 10.0::DOUBLE) AS sn, cos(event_id % 9 / 10.0::DOUBLE) AS cs, fx - 0.05::DOUBLE AS gx, fy AS gy, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END AS trust FROM d JOIN md USING (k)),
c AS (SELECT *, i > 0 AND bad = 0 AS ok, cs * gx - sn * gy AS ax, sn * gx + cs * gy AS ay, 0.0::DOUBLE AS az FROM b),
v AS (SELECT *, CASE WHEN ok THEN 0.5 * (CASE WHEN lag(ok) OVER w THEN lag(ax) OVER w ELSE ax END + ax) * dt ELSE 0 END AS dx, CASE WHEN ok THEN 0.5 * (CASE WHEN lag(ok) OVER w THEN lag(ay) OVER w ELSE ay END + ay) * dt ELSE 0 END AS dy FROM c WINDOW w AS (PARTITION BY k ORDER BY i)),
u AS (SELECT *, k % 4 + sum(dx) OVER w AS vx, sum(dy) OVER w AS vy FROM v WINDOW w AS (PARTITION BY k ORDER BY i))
SELECT k, i, {rs('vx')} AS v_x, {rs('vy')} AS v_y, {rs('sum(CASE WHEN ok THEN (vx - 0.5 * dx) * dt ELSE 0 END) OVER w')} AS p_x, {rs('sum(CASE WHEN ok THEN (vy - 0.5 * dy) * dt ELSE 0 END) OVER w')} AS p_y,
  (bad + CASE WHEN i > 0 AND bad <> 16 AND (dt / med > 5 OR dt / med < 0.2) THEN 4 ELSE 0 END + CASE WHEN i > 0 AND event_id % 6 = 0 THEN 64 ELSE 0 END + CASE WHEN ok AND trust IS NULL THEN 2 WHEN ok AND trust < 0.25 THEN 1 ELSE 0 END)::INTEGER AS flags
FROM u WINDOW w AS (PARTITION BY k ORDER BY i)""")
def navigate_flags(spark: SparkSession, d: str) -> DataFrame:
    """Propagation of every user's recording with given attitudes, a bias, a start velocity and all flags of its steps."""
    types = table(spark, d, "events").select(F.col("user_id").alias("k"), micros("ts").alias("at"), "event_id")
    w = W.partitionBy("k").orderBy("at", "event_id")
    rows = measured(spark, d).join(types.select("k", "event_id", (F.row_number().over(w) - 1).alias("i")), ["k", "i"])
    angle = (F.col("event_id") % 9) / 10.0
    rows = rows.withColumns({"us": F.round(F.col("t_s") * 1e6).cast("long"), "q_x": F.lit(0.0), "q_y": F.lit(0.0), "q_z": F.sin(angle / 2), "q_w": F.cos(angle / 2), "accel_bias_x": F.lit(0.05), "accel_bias_y": F.lit(0.0), "accel_bias_z": F.lit(0.0)})
    trust = F.when(F.col("k") % 3 == 1, 0.1).when(F.col("k") % 3 == 2, 0.9)
    rows = rows.withColumns({"v0_x": (F.col("k") % 4).cast("double"), "stationary": F.col("event_id") % 6 == 0, "alignment_confidence": trust})
    rows = rows.join(navigation.median_step(rows, "k", ["i"], "us"), "k")
    out = navigation.propagate(rows, "k", ["i"], "us")
    return rounded(out.select("k", "i", "v_x", "v_y", "p_x", "p_y", "flags"), "v_x", "v_y", "p_x", "p_y")


def _attitude() -> str:
    """m: the attitude of each recording, step by step."""
    s = """(SELECT r.k, r.i, r.t, r.t - m.t AS dt, o.wx, o.wy, o.wz, r.ax, r.ay, r.az, r.n, m.qx, m.qy, m.qz, m.qw,
      CASE WHEN r.t - m.t > 0.5 OR o.wx IS NULL THEN 2 WHEN sqrt(o.wx*o.wx + o.wy*o.wy + o.wz*o.wz) > 35 THEN 3 ELSE 1 END AS kind, coalesce(abs(r.n - 9.80665) <= 0.5, false) AS calm
      FROM m JOIN r ON r.k = m.k AND r.i = m.i + 1 JOIN r o ON o.k = m.k AND o.i = m.i)"""
    s = _product(_spin(_stage(s, **{f"s{a}": f"CASE WHEN kind = 1 THEN w{a}*dt ELSE 0 END" for a in "xyz"}), "s", "d"), "q", "d", "h")
    s = _turned(_stage(s, **{f"l{a}": f"a{a}/n" for a in "xyz"}), "h", "l", "g")
    s = _stage(s, pn="sqrt(gx*gx + gy*gy + (1+gz)*(1+gz))")  # the shortest turn of g to up: (gy, -gx, 0, 1 + gz), made a unit
    s = _stage(s, an="sqrt(gx*gx + gy*gy)/pn", aw="(1+gz)/pn")
    s = _stage(s, f="2*atan2(an, aw)*least(1.0, 0.5*least(dt, 0.5))")
    s = _spin(_stage(s, yx="CASE WHEN an < 1e-12 THEN 0 ELSE gy/pn/an*f END", yy="CASE WHEN an < 1e-12 THEN 0 ELSE -gx/pn/an*f END", yz="0.0"), "y", "j")
    s = _product(s, "j", "h", "z")
    step = f"SELECT k, i, t, {', '.join(f'CASE WHEN calm THEN z{a} ELSE h{a} END' for a in 'xyzw')}, calm, kind FROM {s}"
    return f"m(k, i, t, qx, qy, qz, qw, calm, kind) AS (SELECT r.k, i, t, coalesce(uy/un, 0), coalesce(-ux/un, 0), 0.0::DOUBLE, coalesce((1+uz)/un, 1), false, 0 FROM r JOIN g USING (k) WHERE i = 0 UNION ALL {step})"


def worn(spark: SparkSession, d: str) -> DataFrame:
    """Each user as a phone at ten rows a second: what it feels is tilted and shaken by the values, its gyroscope saturates and drops out now and then, and a gap comes after three seconds; users of even number have a gravity channel."""
    w = W.partitionBy("k").orderBy("t", "event_id")
    rows = events(spark, d).withColumn("i", F.row_number().over(w) - 1)
    odd = F.when(F.col("event_id") % 53 == 0, 1000.0).otherwise(1.0)
    rate = lambda c: F.when(F.col("event_id") % 37 > 0, c * odd)
    axes = {"accel_x": (F.col("event_id") % 13 - 6) / 5.0 + 1.5, "accel_y": F.when(F.col("event_id") % 43 > 0, F.lit(5.88399)), "accel_z": 7.7 + F.col("x") / 200}
    axes |= {"gyro_x": rate((F.col("event_id") % 7 - 3) / 10.0), "gyro_y": rate((F.col("event_id") % 5 - 2) / 8.0), "gyro_z": rate((F.col("event_id") % 11 - 5) / 20.0)}
    axes |= {f"gravity_{a}": F.when(F.col("k") % 2 == 0, c) for a, c in (("x", (F.col("event_id") % 3 - 1) / 10.0), ("y", F.lit(5.88399)), ("z", F.lit(7.84532)))}
    return rows.select("k", "i", (F.col("i") * 0.1 + F.when(F.col("i") >= 30, 2.0).otherwise(0.0)).alias("t_s"), *[c.alias(n) for n, c in axes.items()])


@query(f"""WITH RECURSIVE {E_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) - 1 AS i, CASE WHEN event_id % 53 = 0 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS odd FROM e),
v AS (SELECT k, i, i * 0.1::DOUBLE + CASE WHEN i >= 30 THEN 2.0::DOUBLE ELSE 0 END AS t, (event_id % 13 - 6) / 5.0::DOUBLE + 1.5 AS ax, CASE WHEN event_id % 43 > 0 THEN 5.88399::DOUBLE END AS ay, 7.7::DOUBLE + x / 200 AS az,
  CASE WHEN event_id % 37 > 0 THEN (event_id % 7 - 3) / 10.0::DOUBLE * odd END AS wx, CASE WHEN event_id % 37 > 0 THEN (event_id % 5 - 2) / 8.0::DOUBLE * odd END AS wy, CASE WHEN event_id % 37 > 0 THEN (event_id % 11 - 5) / 20.0::DOUBLE * odd END AS wz,
  (event_id % 3 - 1) / 10.0::DOUBLE AS cx, k % 2 = 0 AS ch FROM b),
r AS MATERIALIZED (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS n, sqrt(cx*cx + 5.88399::DOUBLE*5.88399 + 7.84532::DOUBLE*7.84532) AS cn FROM v),
pick AS (SELECT k, CASE WHEN count(*) FILTER (ch) >= 20 THEN 'c' WHEN count(wx) > 0 THEN 'w' ELSE 's' END AS pick FROM r GROUP BY k),
own AS (SELECT r.k, CASE WHEN pick = 'c' THEN cx ELSE ax END AS x, CASE WHEN pick = 'c' THEN 5.88399::DOUBLE ELSE ay END AS y, CASE WHEN pick = 'c' THEN 7.84532::DOUBLE ELSE az END AS z, CASE WHEN pick = 'c' THEN cn ELSE n END AS n
  FROM r JOIN pick USING (k) WHERE CASE pick WHEN 'c' THEN ch WHEN 'w' THEN abs(n - 9.80665) <= 0.5 AND sqrt(wx*wx + wy*wy + wz*wz) <= 0.1 ELSE abs(n - 9.80665) <= 0.5 END),
mean AS (SELECT k, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM own GROUP BY k HAVING count(*) >= 20),
u AS (SELECT k, x / sqrt(x*x + y*y + z*z) AS ux, y / sqrt(x*x + y*y + z*z) AS uy, z / sqrt(x*x + y*y + z*z) AS uz FROM mean),
conf AS (SELECT k, greatest(0, least(1, 1 - sqrt(avg(acos(greatest(-1, least(1, (x*ux + y*uy + z*uz) / n))) ** 2)) / 0.35)) * greatest(0, least(1, 1 - abs(avg(n) - 9.80665) / (0.2 * 9.80665))) * (0.5 + 0.5 * least(1, count(*) / 200.0::DOUBLE)) AS gc FROM own JOIN u USING (k) GROUP BY k),
g AS (SELECT k, ux, uy, uz, sqrt(ux*ux + uy*uy + (1+uz)*(1+uz)) AS un, least(0.5, coalesce(gc, 0) * CASE WHEN has THEN 1 ELSE 0.5 END) AS confidence FROM (SELECT k, count(wx) > 0 AS has FROM r GROUP BY k) LEFT JOIN u USING (k) LEFT JOIN conf USING (k)),
{_attitude()}
SELECT m.k, i, {', '.join(f"{rs(f'q{a}')} AS q_{a}" for a in 'xyzw')}, {rs('confidence')} AS confidence, calm AS level_corrected, false AS heading_corrected, CASE kind WHEN 0 THEN 'none' WHEN 1 THEN 'integrated' WHEN 2 THEN 'skipped' ELSE 'saturated' END AS step FROM m JOIN g USING (k)""")
def orientation_scan(spark: SparkSession, d: str) -> DataFrame:
    """Attitude of every sample of every user's recording, from its gravity estimate on; SQL walks the samples one after the other."""
    out = attitude.orientation(worn(spark, d), "k", ["i"], gyro="gyro", gravity="gravity")
    names = [*[f"q_{a}" for a in "xyzw"], "confidence"]
    return rounded(out.select("k", "i", *names, "level_corrected", "heading_corrected", "step"), *names)


_CASES = " UNION ALL ".join([_NO_BIAS] + [
    f"SELECT {1 + n} AS c, " + ", ".join(f"{m if s == sensor and a == axis else 0.0}::DOUBLE AS b{s}{a}" for s in "wf" for a in "xyz")
    for n, (sensor, axis, m) in enumerate([("w", a, m) for m in P.GYRO_PERTURBATIONS_RPS for a in "xyz"] + [("f", a, m) for m in P.ACCEL_PERTURBATIONS_MPS2 for a in "xyz"])
])


@query(f"""WITH RECURSIVE {E_SQL}, {MEASURED_SQL}, {_strapdown(_CASES)}, last AS (SELECT k, max(i) AS i FROM r GROUP BY k), ends AS (SELECT m.k, c, px, py, pz FROM m JOIN last USING (k, i))
SELECT b.k, CASE WHEN b.c <= 12 THEN 'gyro' ELSE 'accel' END AS sensor, ((b.c - 1) % 3)::INTEGER AS axis,
  ([{', '.join(f'{m}::DOUBLE' for m in (*P.GYRO_PERTURBATIONS_RPS, *P.ACCEL_PERTURBATIONS_MPS2))}])[(b.c - 1) // 3 + 1] AS magnitude, {rs('sqrt((b.px-a.px)**2 + (b.py-a.py)**2 + (b.pz-a.pz)**2)')} AS divergence_m
FROM ends b JOIN ends a ON a.k = b.k AND a.c = 0 WHERE b.c > 0""")
def bias_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """How far the end of every user's trajectory moves for each bias of a fixed list; SQL walks each case by itself."""
    return rounded(scans.bias_sensitivity(measured(spark, d), "k"), "divergence_m")


@query()
def mechanize_events(spark: SparkSession, d: str) -> DataFrame:
    """Strapdown propagation over every recording of events, level and without rotation, on an even clock: velocity is the running sum of trapezoids."""
    w = W.partitionBy("k").orderBy("t", "event_id")
    rows = events(spark, d).withColumn("i", F.row_number().over(w) - 1)
    rows = rows.select("k", (F.col("i") * 0.1).alias("t_s"), (F.col("x") / 1000).alias("force_x"), F.lit(0.0).alias("force_y"), F.lit(9.80665).alias("force_z"), *[F.lit(0.0).alias(f"gyro_{c}") for c in "xyz"])
    out = scans.mechanize(rows, "k")
    return out.groupBy("k").agg(F.count("*").alias("n"), F.max_by("v_x", "t_s").alias("v")).select("k", "n", r("v", 9).alias("velocity"))


SQL["mechanize_events"] = f"""WITH {E_SQL}, i AS (SELECT k, row_number() OVER w - 1 AS i, x / 1000 AS a, lag(x / 1000) OVER w AS b FROM e WINDOW w AS (PARTITION BY k ORDER BY t, event_id))
SELECT k, count(*) AS n, {rs('sum(CASE WHEN i = 1 THEN a * 0.1 WHEN i > 1 THEN (a + b) / 2 * 0.1 ELSE 0 END)', 9)} AS velocity FROM i GROUP BY k"""
