"""Quaternions as (x, y, z, w) columns: Hamilton product, active rotations, right-handed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import EULER_GIMBAL_LIMIT_RAD, MIN_VECTOR_NORM, QUATERNION_NORM_TOLERANCE
from . import vectors as V

Quaternion = tuple[Column, Column, Column, Column]
Matrix = tuple[tuple[Column, ...], ...]
IDENTITY = (0.0, 0.0, 0.0, 1.0)


def identity() -> Quaternion:
    return tuple(F.lit(x) for x in IDENTITY)


def quaternion(prefix: str) -> Quaternion:
    return tuple(F.col(f"{prefix}_{a}") for a in "xyzw")


def pack(q: Quaternion) -> Column:
    return F.struct(*[c.alias(a) for c, a in zip(q, "xyzw", strict=True)])


def norm(q: Quaternion) -> Column:
    return F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])


def is_normalized(q: Quaternion, tolerance: float = QUATERNION_NORM_TOLERANCE) -> Column:
    return F.abs(norm(q) - 1.0) <= tolerance


def normalize(q: Quaternion) -> Quaternion:
    n = norm(q)
    return tuple(F.when(n >= MIN_VECTOR_NORM, c / n) for c in q)


def conjugate(q: Quaternion) -> Quaternion:
    return -q[0], -q[1], -q[2], q[3]


def inverse(q: Quaternion) -> Quaternion:
    n2 = q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]
    return tuple(F.when(n2 >= MIN_VECTOR_NORM**2, c / n2) for c in conjugate(q))


def multiply(a: Quaternion, b: Quaternion) -> Quaternion:
    va, vb = a[:3], b[:3]
    v = V.add(V.add(V.scale(vb, a[3]), V.scale(va, b[3])), V.cross(va, vb))
    return *v, a[3] * b[3] - V.dot(va, vb)


def rotate(q: Quaternion, v: V.Vector) -> V.Vector:
    """q v q*, as v + 2 w (u x v) + 2 u x (u x v)."""
    t = V.scale(V.cross(q[:3], v), F.lit(2.0))
    return V.add(V.add(v, V.scale(t, q[3])), V.cross(q[:3], t))


def from_axis_angle(axis: V.Vector, angle: Column) -> Quaternion:
    s = F.sin(angle / 2)
    return *V.scale(V.unit(axis), s), F.cos(angle / 2)


def to_axis_angle(q: Quaternion) -> tuple[V.Vector, Column]:
    """Axis and an angle from 0 to pi; the x axis where there is no rotation."""
    sign = F.when(q[3] < 0, -1.0).otherwise(1.0)
    n = V.norm(q[:3])
    axis = tuple(F.when(n < MIN_VECTOR_NORM, F.lit(d)).otherwise(sign * c / n) for c, d in zip(q[:3], (1.0, 0.0, 0.0), strict=True))
    return axis, 2 * F.atan2(n, F.abs(q[3]))


def to_matrix(q: Quaternion) -> Matrix:
    x, y, z, w = q
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def from_matrix(m: Matrix) -> Quaternion:
    """The largest of the four components by size is taken from the diagonal, the others by division; w is never negative."""
    (a, b, c), (d, e, f), (g, h, i) = m
    squares = (1 + a - e - i, 1 - a + e - i, 1 - a - e + i, 1 + a + e + i)  # 4 x^2, 4 y^2, 4 z^2, 4 w^2
    off = {(0, 1): b + d, (0, 2): c + g, (1, 2): f + h, (0, 3): h - f, (1, 3): c - g, (2, 3): d - b}
    top = F.greatest(*squares)

    def component(j: int) -> Column:
        out = None
        for k in (3, 0, 1, 2):  # the first of equal ones
            root = F.sqrt(F.greatest(squares[k], F.lit(0.0)))
            value = root / 2 if j == k else off[min(j, k), max(j, k)] / (2 * root)
            out = F.when(squares[k] >= top, value) if out is None else out.when(squares[k] >= top, value)
        return out

    q = tuple(component(j) for j in range(4))
    sign = F.when(q[3] < 0, -1.0).otherwise(1.0)
    return tuple(c * sign for c in q)


def from_euler(roll: Column, pitch: Column, yaw: Column) -> Quaternion:
    """Intrinsic yaw (z), pitch (y), roll (x)."""
    zero, one = F.lit(0.0), F.lit(1.0)
    about = lambda axis, a: from_axis_angle(axis, a)
    return multiply(multiply(about((zero, zero, one), yaw), about((zero, one, zero), pitch)), about((one, zero, zero), roll))


def _sin_pitch(q: Quaternion) -> Column:
    x, y, z, w = q
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))


def euler_is_well_conditioned(q: Quaternion, limit: float = EULER_GIMBAL_LIMIT_RAD) -> Column:
    return F.abs(F.abs(F.asin(_sin_pitch(q))) - F.lit(3.141592653589793 / 2)) > limit


def to_euler(q: Quaternion) -> tuple[Column, Column, Column]:
    """(roll, pitch, yaw); at the poles roll is 0 and yaw takes the whole turn."""
    x, y, z, w = q
    ok = euler_is_well_conditioned(q)
    roll = F.when(ok, F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))).otherwise(0.0)
    yaw = F.when(ok, F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))).otherwise(F.atan2(-2 * (x * y - z * w), 1 - 2 * (x * x + z * z)))
    return roll, F.asin(_sin_pitch(q)), yaw


def angular_distance(a: Quaternion, b: Quaternion) -> Column:
    d = multiply(conjugate(a), b)
    return 2 * F.atan2(V.norm(d[:3]), F.abs(d[3]))


def close(a: Quaternion, b: Quaternion, tolerance: float) -> Column:
    return angular_distance(a, b) <= tolerance


def slerp(a: Quaternion, b: Quaternion, fraction: Column) -> Quaternion:
    """The shorter arc; linear where the two are nearly the same."""
    d = sum((p * q for p, q in zip(a, b, strict=True)), F.lit(0.0))
    b = tuple(F.when(d < 0, -c).otherwise(c) for c in b)
    d = F.least(F.abs(d), F.lit(1.0))
    theta = F.acos(d)
    near = d > 0.9995
    wa = F.when(near, 1 - fraction).otherwise(F.sin((1 - fraction) * theta) / F.sin(theta))
    wb = F.when(near, fraction).otherwise(F.sin(fraction * theta) / F.sin(theta))
    return normalize(tuple(wa * p + wb * q for p, q in zip(a, b, strict=True)))


def from_two_vectors(source: V.Vector, target: V.Vector) -> Quaternion:
    """The shortest rotation of source onto target; half a turn about some normal axis if they are opposite."""
    a, b = V.unit(source), V.unit(target)
    d = V.dot(a, b)
    plain = normalize((*V.cross(a, b), 1 + d))
    helper = tuple(F.when(F.abs(a[0]) < 0.9, F.lit(p)).otherwise(F.lit(q)) for p, q in ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0)))
    axis = V.unit(V.cross(a, helper))
    return tuple(F.when(d < -1 + 1e-12, t).otherwise(p) for p, t in zip(plain, (*axis, F.lit(0.0)), strict=True))


def propagate(q: Quaternion, rate: V.Vector, dt: Column) -> Quaternion:
    """q times the rotation by rate * dt in the body's axes; unchanged for dt <= 0."""
    n = V.norm(rate)
    half = n * dt / 2
    k = F.when(n < MIN_VECTOR_NORM, dt / 2).otherwise(F.sin(half) / n)
    step = normalize(multiply(q, (*V.scale(rate, k), F.cos(half))))
    return tuple(F.when(dt > 0, s).otherwise(c) for s, c in zip(step, q, strict=True))
