"""Geodesy on the sphere as Column expressions: degrees in, metres or degrees out.

Nothing here runs Python per row.  A null or NaN coordinate gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS = 6.371e6
METHODS = ("vincenty", "haversine", "cosines")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within bounds; null stays null, and NaN becomes null (it would order above all numbers)."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def arc(lon1, lat1, lon2, lat2, method: str = "vincenty") -> Column:
    """Angle in radians between two points seen from the centre."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    lat1, lat2, turn = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lon2) - col(lon1))
    level = F.sin(lat1) * F.sin(lat2) + F.cos(lat1) * F.cos(lat2) * F.cos(turn)
    if method == "vincenty":
        east, north = F.cos(lat2) * F.sin(turn), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(turn)
        out = F.atan2(F.sqrt(east * east + north * north), level)
    elif method == "haversine":
        a, b = F.sin((lat2 - lat1) / 2), F.sin(turn / 2)
        out = 2 * F.asin(clip(F.sqrt(a * a + F.cos(lat1) * F.cos(lat2) * b * b), -1.0, 1.0))
    else:
        out = F.acos(clip(level, -1.0, 1.0))
    return F.nanvl(out, F.lit(None).cast("double"))


def distance(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS, method: str = "vincenty") -> Column:
    """Great-circle distance, in the unit of ``radius``."""
    return arc(lon1, lat1, lon2, lat2, method) * radius


def corner_angle(a: Column, b: Column, c: Column) -> Column:
    """Angle of a spherical triangle between the sides ``b`` and ``c``, opposite ``a``; all in radians.

    Null where it is undefined: both sides of the quotient are zero.
    """
    above, below = F.cos(a) - F.cos(b) * F.cos(c), F.sin(b) * F.sin(c)
    flat = F.when(above > 0, F.lit(0.0)).when(above < 0, F.lit(math.pi))
    return F.when(below == 0, flat).otherwise(F.acos(clip(F.try_divide(above, below), -1.0, 1.0)))


def angle(lon_a, lat_a, lon_b, lat_b, lon_c, lat_c) -> Column:
    """Angle at A between the arcs to B and C, in radians."""
    return corner_angle(arc(lon_b, lat_b, lon_c, lat_c), arc(lon_a, lat_a, lon_c, lat_c), arc(lon_a, lat_a, lon_b, lat_b))


def stereographic(lon, lat) -> tuple[Column, Column]:
    """Plane coordinates of the polar stereographic projection from the north pole."""
    down = F.radians(90.0 - clip(col(lat), -90 + 1e-3, 90 - 1e-3))
    reach = F.sin(down) / (1.0 - clip(F.cos(down), -1 + 1e-14, 1 - 1e-14))
    turn = -F.radians(col(lon))
    return reach * F.cos(turn), reach * F.sin(turn)


def arc_point(lon1, lat1, lon2, lat2, r) -> tuple[Column, Column]:
    """Longitude and latitude at the fraction ``r`` (clipped to [0, 1]) of the arc from 1 to 2, evenly spaced.

    Points that coincide give the first point; antipodes, which any arc joins, give null.  Longitudes are above -180 and up to
    180; a point at a pole has the longitude of the first point.
    """
    lam1, phi1, lam2, phi2 = (F.radians(col(x)) for x in (lon1, lat1, lon2, lat2))
    r, whole = clip(col(r), 0.0, 1.0), arc(lon1, lat1, lon2, lat2)
    whole = F.when(whole < math.pi - 1e-9, whole)
    a = F.when(F.sin(whole) == 0, F.lit(1.0)).otherwise(F.try_divide(F.sin((1 - r) * whole), F.sin(whole)))
    b = F.when(F.sin(whole) == 0, F.lit(0.0)).otherwise(F.try_divide(F.sin(r * whole), F.sin(whole)))
    x = a * F.cos(phi1) * F.cos(lam1) + b * F.cos(phi2) * F.cos(lam2)
    y = a * F.cos(phi1) * F.sin(lam1) + b * F.cos(phi2) * F.sin(lam2)
    z = a * F.sin(phi1) + b * F.sin(phi2)
    flat = F.sqrt(x * x + y * y)
    lon = F.degrees(F.when(flat < 1e-12, F.atan2(F.sin(lam1), F.cos(lam1))).otherwise(F.atan2(y, x)))
    return F.when(lon < -180 + 1e-9, F.lit(180.0)).otherwise(lon), F.degrees(F.atan2(z, flat))
