"""Vectors as triples of columns; null when a component is null or a direction is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import LOW_DYNAMIC_ACCEL_TOLERANCE_MPS2, LOW_DYNAMIC_GYRO_TOLERANCE_RPS, MIN_VECTOR_NORM, STANDARD_GRAVITY_MPS2

Vector = tuple[Column, Column, Column]


def vector(prefix: str) -> Vector:
    """Columns prefix_x, prefix_y and prefix_z."""
    return tuple(F.col(f"{prefix}_{a}") for a in "xyz")


def constant(x: float, y: float, z: float) -> Vector:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def pack(v: Vector) -> Column:
    return F.struct(*[c.alias(a) for c, a in zip(v, "xyz", strict=True)])


def unpack(c: Column) -> Vector:
    return c["x"], c["y"], c["z"]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def subtract(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vector, k: Column) -> Vector:
    return tuple(x * k for x in a)


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    """Direction of a, null below MIN_VECTOR_NORM."""
    n = norm(a)
    return tuple(F.when(n >= MIN_VECTOR_NORM, x / n) for x in a)


def angle(a: Vector, b: Vector) -> Column:
    """Angle in radians, exact near 0 and pi."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def all_finite(*cols: Column) -> Column:
    out = finite(cols[0])
    for c in cols[1:]:
        out = out & finite(c)
    return out


def clean(c: Column) -> Column:
    """Null for NaN, so that aggregates skip what is missing."""
    return F.nanvl(c, F.lit(None).cast("double"))


def low_dynamic(accel: Vector, gyro: Vector | None = None, accel_tolerance: float = LOW_DYNAMIC_ACCEL_TOLERANCE_MPS2, gyro_tolerance: float = LOW_DYNAMIC_GYRO_TOLERANCE_RPS) -> Column:
    """Near rest: the specific force is close to g and the rotation, where it is known, slow."""
    still = all_finite(*accel) & (F.abs(norm(accel) - STANDARD_GRAVITY_MPS2) <= accel_tolerance)
    return still if gyro is None else still & F.coalesce(norm(gyro) <= gyro_tolerance, F.lit(True))


def plausible(a: Vector, limit: float) -> Column:
    return F.coalesce(all_finite(*a) & (norm(a) <= limit), F.lit(False))


def frame_of(df, prefix: str) -> str:
    """Frame tag of a vector's columns, from their metadata."""
    return df.schema[f"{prefix}_x"].metadata.get("frame", "unknown")


def in_frame(v: Vector, prefix: str, frame: str) -> list[Column]:
    """The vector's columns under a name, tagged with a frame (navigation, vehicle, phone or unknown)."""
    return [c.alias(f"{prefix}_{a}", metadata={"frame": frame}) for c, a in zip(v, "xyz", strict=True)]


def require_frame(df, prefix: str, frame: str) -> None:
    """Plan-time check, so that vectors of two frames are never combined."""
    found = frame_of(df, prefix)
    if found != frame:
        raise ValueError(f"{prefix} is in frame {found}, not {frame}")
