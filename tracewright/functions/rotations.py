"""Rotation matrices as 3 x 3 tuples of columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import EULER_GIMBAL_LIMIT_RAD, ORTHONORMALITY_TOLERANCE
from . import quaternions as Q
from . import vectors as V

Matrix = tuple[tuple[Column, ...], ...]


def identity() -> Matrix:
    return tuple(tuple(F.lit(1.0 if i == j else 0.0) for j in range(3)) for i in range(3))


def transpose(m: Matrix) -> Matrix:
    return tuple(zip(*m, strict=True))


def apply(m: Matrix, v: V.Vector) -> V.Vector:
    return tuple(V.dot(row, v) for row in m)


def compose(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(V.dot(row, col) for col in transpose(b)) for row in a)


def determinant(m: Matrix) -> Column:
    return V.dot(m[0], V.cross(m[1], m[2]))


def orthonormality_error(m: Matrix) -> Column:
    """Largest deviation of the transpose times m from the identity."""
    g = compose(transpose(m), m)
    return F.greatest(*[F.abs(g[i][j] - (1.0 if i == j else 0.0)) for i in range(3) for j in range(3)])


def is_rotation(m: Matrix, tolerance: float = ORTHONORMALITY_TOLERANCE) -> Column:
    return F.coalesce((orthonormality_error(m) <= tolerance) & (F.abs(determinant(m) - 1.0) <= tolerance), F.lit(False))


def require_rotation(m: Matrix, name: str = "matrix") -> Matrix:
    """The matrix; the query fails at a row where it isn't a rotation."""
    ok = is_rotation(m)
    return tuple(tuple(F.when(ok, c).otherwise(F.raise_error(F.lit(f"{name} is not a rotation")).cast("double")) for c in row) for row in m)


def inverse(m: Matrix) -> Matrix:
    return transpose(require_rotation(m))


def basis_from_up_and_forward(up: V.Vector, hint: V.Vector) -> Matrix:
    """Columns forward, left, up; null if the hint is parallel to up."""
    u = V.unit(up)
    forward = V.unit(V.subtract(hint, V.scale(u, V.dot(hint, u))))
    return transpose((forward, V.cross(u, forward), u))


def tilt(up: V.Vector) -> Matrix:
    """Takes the measured up direction to the z axis, with a forward of no meaning: the first axis that isn't close to up."""
    u = V.unit(up)
    hint = tuple(F.when(F.abs(u[0]) < 0.9, F.lit(a)).otherwise(F.lit(b)) for a, b in ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0)))
    return transpose(basis_from_up_and_forward(up, hint))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def orthonormalize(rows: pd.Series) -> pd.Series:
    """Nearest rotation to 9 numbers (row by row), by singular values; null rows stay null."""
    out = []
    for r in rows:
        if r is None or not np.isfinite(r).all():
            out.append(None)
            continue
        u, _, vt = np.linalg.svd(np.asarray(r, dtype=float).reshape(3, 3))
        out.append((u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))]) @ vt).ravel())
    return pd.Series(out)


def flat(m: Matrix) -> Column:
    return F.array(*[c for row in m for c in row])


def unflat(a: Column) -> Matrix:
    return tuple(tuple(a[3 * i + j] for j in range(3)) for i in range(3))


def from_basis(forward: V.Vector, left: V.Vector, up: V.Vector) -> Matrix:
    return unflat(orthonormalize(flat(transpose((forward, left, up)))))


@dataclass(frozen=True)
class FrameRotation:
    """A rotation with the frames it leads from and to; frames are checked when the plan is made."""

    matrix: Matrix
    to: str
    of: str

    @classmethod
    def from_quaternion(cls, q: Q.Quaternion, to: str, of: str) -> FrameRotation:
        return cls(Q.to_matrix(q), to, of)

    @classmethod
    def identity_between(cls, to: str, of: str) -> FrameRotation:
        return cls(identity(), to, of)

    def compose(self, inner: FrameRotation) -> FrameRotation:
        if inner.to != self.of:
            raise ValueError(f"{self.to}<-{self.of} can't follow {inner.to}<-{inner.of}")
        return FrameRotation(compose(self.matrix, inner.matrix), self.to, inner.of)

    def inverse(self) -> FrameRotation:
        return FrameRotation(transpose(self.matrix), self.of, self.to)

    def kept(self, df, name: str):
        """(df with the matrix in an array column, the rotation that reads it): what is built on it doesn't write the matrix's expressions out again at each use."""
        return df.withColumn(name, flat(self.matrix)), FrameRotation(unflat(F.col(name)), self.to, self.of)

    def angle_to(self, other: FrameRotation) -> Column:
        """Angle between two rotations, exact at both ends: of the turn between them, twice the sine is the length of its skew part and twice the cosine its trace less one."""
        m = compose(transpose(self.matrix), other.matrix)
        skew = (m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1])
        return F.atan2(V.norm(skew), m[0][0] + m[1][1] + m[2][2] - 1.0)

    def euler_deg(self) -> tuple[Column, Column, Column]:
        """Roll, pitch and yaw in degrees, with the convention of quaternions.to_euler: at the poles roll is 0 and yaw takes the whole turn."""
        m = self.matrix
        s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[2][0]))
        pole = F.abs(F.abs(F.asin(s)) - F.lit(np.pi / 2)) <= EULER_GIMBAL_LIMIT_RAD
        roll = F.when(pole, 0.0).otherwise(F.atan2(m[2][1], m[2][2]))
        yaw = F.when(pole, F.atan2(-m[0][1], m[1][1])).otherwise(F.atan2(m[1][0], m[0][0]))
        return tuple(F.degrees(c) for c in (roll, F.asin(s), yaw))

    def apply_series(self, df, prefix: str, out: str):
        """The vector's columns turned into the other frame and tagged with it."""
        V.require_frame(df, prefix, self.of)
        return df.select("*", *V.in_frame(apply(self.matrix, V.vector(prefix)), out, self.to))
