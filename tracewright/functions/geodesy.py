"""Tangent plane, normal gravity and angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from . import vectors as V


def _w2(lat: Column, e2: float) -> Column:
    return 1 - e2 * F.pow(F.sin(F.radians(lat)), F.lit(2.0))


def meridional_radius(lat: Column) -> Column:
    return P.WGS84_SEMI_MAJOR_M * (1 - P.WGS84_E2) / F.pow(_w2(lat, P.WGS84_E2), F.lit(1.5))


def transverse_radius(lat: Column) -> Column:
    return P.WGS84_SEMI_MAJOR_M / F.sqrt(_w2(lat, P.WGS84_E2))


def to_enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> V.Vector:
    """East, north, up in metres from an origin; null where a coordinate is missing."""
    h0 = F.coalesce(alt0, F.lit(0.0))
    east = F.radians(lon - lon0) * (transverse_radius(lat0) + h0) * F.cos(F.radians(lat0))
    north = F.radians(lat - lat0) * (meridional_radius(lat0) + h0)
    return east, north, alt - h0


def normal_gravity(lat: Column, alt: Column) -> Column:
    """Gravity on the ellipsoid less the free-air gradient; equator and height 0 where these are missing."""
    s2 = F.pow(F.sin(F.radians(F.coalesce(lat, F.lit(0.0)))), F.lit(2.0))
    g0 = P.SOMIGLIANA_GAMMA_E * (1 + P.SOMIGLIANA_K * s2) / F.sqrt(1 - P.SOMIGLIANA_E2 * s2)
    return g0 - P.FREE_AIR_GRADIENT * F.coalesce(alt, F.lit(0.0))


def gravity_acceleration(g: Column) -> V.Vector:
    """Gravity in navigation axes: it points down."""
    return F.lit(0.0), F.lit(0.0), -g


def linear_acceleration(force: V.Vector, gravity: V.Vector) -> V.Vector:
    """Motion is what is felt plus gravity."""
    return V.add(force, gravity)


def wrap_deg(a: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def rotate_about_z(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return F.cos(angle) * x - F.sin(angle) * y, F.sin(angle) * x + F.cos(angle) * y


def is_fix(lat: Column, lon: Column) -> Column:
    return F.coalesce(V.all_finite(lat, lon) & ~((lat == 0) & (lon == 0)), F.lit(False))
