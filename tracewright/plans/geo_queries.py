"""Queries on vectors, quaternions, rotations and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import quaternions as Q
from ..functions import rotations as R
from ..functions import vectors as V
from .common import E_SQL, events, r, rs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    """Two unit quaternions p and q, a vector v and a vector w from each embedding."""
    e = F.col("embedding")
    at = lambda i: e[i].cast("double")
    df = table(spark, d, "embeddings").select("vec_id", *[at(i).alias(f"a{i}") for i in range(14)])
    for name, k in (("p", 0), ("q", 4)):
        n = F.sqrt(sum((F.col(f"a{k + i}") * F.col(f"a{k + i}") for i in range(4)), F.lit(0.0)))
        df = df.select("*", *[(F.col(f"a{k + i}") / n).alias(f"{name}_{c}") for i, c in enumerate("xyzw")])
    return df.select("vec_id", *[f"{n}_{c}" for n in "pq" for c in "xyzw"], *[F.col(f"a{8 + i}").alias(f"v_{c}") for i, c in enumerate("xyz")], *[F.col(f"a{11 + i}").alias(f"w_{c}") for i, c in enumerate("xyz")])


_N = lambda k: " + ".join(f"embedding[{k + i}]::DOUBLE * embedding[{k + i}]::DOUBLE" for i in range(1, 5))
_Q = (
    "b AS (SELECT vec_id, "
    + ", ".join(f"embedding[{k + i + 1}]::DOUBLE / sqrt({_N(k)}) AS {n}{c}" for n, k in (("p", 0), ("q", 4)) for i, c in enumerate("xyzw"))
    + ", "
    + ", ".join(f"embedding[{k + i + 1}]::DOUBLE AS {n}{c}" for n, k in (("v", 8), ("u", 11)) for i, c in enumerate("xyz"))
    + " FROM embeddings)"
)
#: Components of the Hamilton product, with signs written out.
_PROD = {
    "x": "{a}w * {b}x + {a}x * {b}w + {a}y * {b}z - {a}z * {b}y",
    "y": "{a}w * {b}y - {a}x * {b}z + {a}y * {b}w + {a}z * {b}x",
    "z": "{a}w * {b}z + {a}x * {b}y - {a}y * {b}x + {a}z * {b}w",
    "w": "{a}w * {b}w - {a}x * {b}x - {a}y * {b}y - {a}z * {b}z",
}
_M = [
    ["1 - 2 * (py * py + pz * pz)", "2 * (px * py - pz * pw)", "2 * (px * pz + py * pw)"],
    ["2 * (px * py + pz * pw)", "1 - 2 * (px * px + pz * pz)", "2 * (py * pz - px * pw)"],
    ["2 * (px * pz - py * pw)", "2 * (py * pz + px * pw)", "1 - 2 * (px * px + py * py)"],
]


@query(
    f"WITH {_Q} SELECT vec_id, "
    + ", ".join(f"{rs(_PROD[c].format(a='p', b='q'))} AS prod_{c}" for c in "xyzw")
    + ", "
    + ", ".join(f"{rs(f'({_M[i][0]}) * vx + ({_M[i][1]}) * vy + ({_M[i][2]}) * vz')} AS rot_{c}" for i, c in enumerate("xyz"))
    + f", {rs('2 * acos(least(1, abs(px * qx + py * qy + pz * qz + pw * qw)))', 4)} AS distance, {rs('2 * acos(least(1, abs(pw)))', 4)} AS angle"
    + ", "
    + ", ".join(f"{rs(e)} AS inv_{c}" for e, c in (("-px", "x"), ("-py", "y"), ("-pz", "z"), ("pw", "w")))
    + ", true AS normalized FROM b"
)
def quat_ops(spark: SparkSession, d: str) -> DataFrame:
    p, q, v = Q.quaternion("p"), Q.quaternion("q"), V.vector("v")
    return _embedded(spark, d).select(
        "vec_id", *[r(c).alias(f"prod_{n}") for c, n in zip(Q.multiply(p, q), "xyzw", strict=True)], *[r(c).alias(f"rot_{n}") for c, n in zip(Q.rotate(p, v), "xyz", strict=True)],
        r(Q.angular_distance(p, q), 4).alias("distance"), r(Q.to_axis_angle(p)[1], 4).alias("angle"), *[r(c).alias(f"inv_{n}") for c, n in zip(Q.inverse(p), "xyzw", strict=True)], Q.is_normalized(p).alias("normalized"),
    )


@query(
    f"WITH {_Q} SELECT vec_id, {rs('atan2(2 * (pw * px + py * pz), 1 - 2 * (px * px + py * py))')} AS roll, {rs('asin(greatest(-1, least(1, 2 * (pw * py - pz * px))))')} AS pitch, {rs('atan2(2 * (pw * pz + px * py), 1 - 2 * (py * py + pz * pz))')} AS yaw, true AS back FROM b"
)
def euler_angles(spark: SparkSession, d: str) -> DataFrame:
    p = Q.quaternion("p")
    roll, pitch, yaw = Q.to_euler(p)
    return _embedded(spark, d).select("vec_id", r(roll).alias("roll"), r(pitch).alias("pitch"), r(yaw).alias("yaw"), (Q.angular_distance(Q.from_euler(roll, pitch, yaw), p) < 1e-6).alias("back"))


@query(
    f"""WITH {_Q}, s AS (SELECT *, abs(px * qx + py * qy + pz * qz + pw * qw) AS d, CASE WHEN px * qx + py * qy + pz * qz + pw * qw < 0 THEN -1 ELSE 1 END AS sg FROM b),
t AS (SELECT *, sin(0.7 * acos(least(1, d))) / sin(acos(least(1, d))) AS wa, sin(0.3 * acos(least(1, d))) / sin(acos(least(1, d))) AS wb FROM s)
SELECT vec_id, """
    + ", ".join(f"{rs(f'CASE WHEN d > 0.9995 THEN (0.7 * p{c} + 0.3 * sg * q{c}) ELSE wa * p{c} + wb * sg * q{c} END', 5)} AS s_{c}" for c in "xyzw")
    + " FROM t"
)
def slerp(spark: SparkSession, d: str) -> DataFrame:
    s = Q.slerp(Q.quaternion("p"), Q.quaternion("q"), F.lit(0.3))
    return _embedded(spark, d).select("vec_id", *[r(c, 5).alias(f"s_{n}") for c, n in zip(s, "xyzw", strict=True)])


@query(
    f"""WITH {_Q}, n AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS nv, sqrt(ux * ux + uy * uy + uz * uz) AS nu FROM b),
h AS (SELECT *, sqrt((1 + (vx * ux + vy * uy + vz * uz) / (nv * nu)) / 2) AS c FROM n)
SELECT vec_id, {rs('(vy * uz - vz * uy) / (nv * nu) / (2 * c)', 5)} AS t_x, {rs('(vz * ux - vx * uz) / (nv * nu) / (2 * c)', 5)} AS t_y, {rs('(vx * uy - vy * ux) / (nv * nu) / (2 * c)', 5)} AS t_z, {rs('c', 5)} AS t_w, {rs('acos(greatest(-1, least(1, (vx * ux + vy * uy + vz * uz) / (nv * nu))))', 4)} AS angle FROM h"""
)
def two_vector_rotation(spark: SparkSession, d: str) -> DataFrame:
    v, w = V.vector("v"), V.vector("w")
    t = Q.from_two_vectors(v, w)
    return _embedded(spark, d).select("vec_id", *[r(c, 5).alias(f"t_{n}") for c, n in zip(t, "xyzw", strict=True)], r(V.angle(v, w), 4).alias("angle"))


@query(
    f"WITH {_Q} SELECT vec_id, "
    + ", ".join(f"{rs(_M[i][j])} AS m{i}{j}" for i in range(3) for j in range(3))
    + ", 1.0::DOUBLE AS det, true AS is_rotation, true AS back FROM b"
)
def rotation_apply(spark: SparkSession, d: str) -> DataFrame:
    p = Q.quaternion("p")
    m = Q.to_matrix(p)
    back = Q.angular_distance(Q.from_matrix(m), p) < 1e-6
    return _embedded(spark, d).select("vec_id", *[r(m[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)], r(R.determinant(m)).alias("det"), R.is_rotation(m).alias("is_rotation"), back.alias("back"))


@query(
    f"""WITH {_Q}, n AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS nv FROM b), z AS (SELECT *, vx / nv AS zx, vy / nv AS zy, vz / nv AS zz FROM n),
f AS (SELECT *, ux - (ux * zx + uy * zy + uz * zz) * zx AS fx, uy - (ux * zx + uy * zy + uz * zz) * zy AS fy, uz - (ux * zx + uy * zy + uz * zz) * zz AS fz FROM z),
g AS (SELECT *, sqrt(fx * fx + fy * fy + fz * fz) AS nf FROM f)
SELECT vec_id, {rs('fx / nf', 5)} AS f_x, {rs('fy / nf', 5)} AS f_y, {rs('fz / nf', 5)} AS f_z, {rs('(zy * fz - zz * fy) / nf', 5)} AS l_x, {rs('(zz * fx - zx * fz) / nf', 5)} AS l_y, {rs('(zx * fy - zy * fx) / nf', 5)} AS l_z, true AS proper FROM g"""
)
def basis(spark: SparkSession, d: str) -> DataFrame:
    m = R.basis_from_up_and_forward(V.vector("v"), V.vector("w"))
    return _embedded(spark, d).select("vec_id", *[r(m[i][0], 5).alias(f"f_{c}") for i, c in enumerate("xyz")], *[r(m[i][1], 5).alias(f"l_{c}") for i, c in enumerate("xyz")], R.is_rotation(m, 1e-6).alias("proper"))


@query(
    f"""WITH {_Q}, w AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS n FROM b), h AS (SELECT *, n * 0.02 / 2 AS a, sin(n * 0.02 / 2) / n AS k FROM w),
s AS (SELECT vec_id, px, py, pz, pw, vx * k AS rx, vy * k AS ry, vz * k AS rz, cos(a) AS rw FROM h)
SELECT vec_id, """
    + ", ".join(f"{rs(_PROD[c].format(a='p', b='r'))} AS q_{c}" for c in "xyzw")
    + " FROM s"
)
def attitude_step(spark: SparkSession, d: str) -> DataFrame:
    q = Q.propagate(Q.quaternion("p"), V.vector("v"), F.lit(0.02))
    return _embedded(spark, d).select("vec_id", *[r(c).alias(f"q_{n}") for c, n in zip(q, "xyzw", strict=True)])


@query(
    f"""WITH {E_SQL}, p AS (SELECT event_id, k, t, CASE WHEN x < 2 THEN 0 ELSE 40 + (x % 10) / 10 END AS lat, CASE WHEN x < 2 THEN 0 ELSE -3 + (event_id % 100) / 100.0::DOUBLE END AS lon, 600 + x % 7 AS alt FROM e),
o AS (SELECT k, arg_min(lat, (t, event_id)) AS lat0, arg_min(lon, (t, event_id)) AS lon0, arg_min(alt, (t, event_id)) AS alt0 FROM p WHERE NOT (lat = 0 AND lon = 0) GROUP BY k),
w AS (SELECT *, 1 - 0.00669437999014 * sin(radians(lat0)) ** 2 AS w2 FROM p JOIN o USING (k))
SELECT event_id, {rs('radians(lon - lon0) * (6378137.0 / sqrt(w2) + alt0) * cos(radians(lat0))', 3)} AS east, {rs('radians(lat - lat0) * (6378137.0 * (1 - 0.00669437999014) / w2 ** 1.5 + alt0)', 3)} AS north, {rs('alt - alt0')} AS up FROM w WHERE NOT (lat = 0 AND lon = 0)"""
)
def enu_projection(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    none = F.col("x") < 2
    p = e.select("event_id", "k", "t", F.when(none, 0.0).otherwise(40 + F.col("x") % 10 / 10).alias("lat"), F.when(none, 0.0).otherwise(-3 + F.col("event_id") % 100 / 100.0).alias("lon"), (600 + F.col("x") % 7).alias("alt"))
    p = p.where(G.is_fix(F.col("lat"), F.col("lon")))
    at = F.struct("t", "event_id")
    o = p.groupBy("k").agg(F.min_by("lat", at).alias("lat0"), F.min_by("lon", at).alias("lon0"), F.min_by("alt", at).alias("alt0"))
    c = F.col
    east, north, up = G.to_enu(c("lat"), c("lon"), c("alt"), c("lat0"), c("lon0"), c("alt0"))
    return p.join(o, "k").select("event_id", r(east, 3).alias("east"), r(north, 3).alias("north"), r(up).alias("up"))


@query(
    f"""SELECT n_nationkey, {rs('9.7803253359 * (1 + 0.00193185265241 * sin(radians(n_nationkey * 3.5)) ** 2) / sqrt(1 - 0.00669437999013 * sin(radians(n_nationkey * 3.5)) ** 2) - 3.086e-06 * n_nationkey * 100', 8)} AS g,
  {rs('((n_nationkey * 37.5 + 180) % 360) - 180')} AS wrapped FROM nation"""
)
def gravity_model(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", r(G.normal_gravity(k * 3.5, k * 100.0), 8).alias("g"), r(G.wrap_deg(k * 37.5)).alias("wrapped"))


@query(f"WITH {E_SQL} SELECT k, {rs('sqrt(avg((((((x * 7 - event_id % 360 + 180) % 360) + 360) % 360) - 180) ** 2))', 4)} AS rmse_deg FROM e GROUP BY k HAVING count(*) >= 10")
def angle_wrap(spark: SparkSession, d: str) -> DataFrame:
    off = G.wrap_deg(F.col("x") * 7 - F.col("event_id") % 360)
    return events(spark, d).groupBy("k").agg(F.count("*").alias("n"), F.sqrt(F.avg(off * off)).alias("e")).where("n >= 10").select("k", r("e", 4).alias("rmse_deg"))


@query(
    f"""WITH {_Q}, d AS (SELECT vec_id, vx * ux + vy * uy + vz * uz AS dot, vy * uz - vz * uy AS cx, vz * ux - vx * uz AS cy, vx * uy - vy * ux AS cz FROM b)
SELECT vec_id, {rs('dot')} AS dot, {rs('cx')} AS c_x, {rs('cy')} AS c_y, {rs('cz')} AS c_z FROM d"""
)
def vector_products(spark: SparkSession, d: str) -> DataFrame:
    v, w = V.vector("v"), V.vector("w")
    return _embedded(spark, d).select("vec_id", r(V.dot(v, w)).alias("dot"), *[r(c).alias(f"c_{n}") for c, n in zip(V.cross(v, w), "xyz", strict=True)])
