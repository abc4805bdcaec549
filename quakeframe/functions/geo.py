"""Geometry: projections, distances, traces and fault planes. Depth is positive down."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import C, clamp, clamp01, col, finite

EARTH_M, MERCATOR_M = 6_371_000.0, 6_378_137.0


def equirectangular(lon: C, lat: C, bbox: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Metres about the centre of (west, south, east, north)."""
    lon0, lat0 = (bbox[0] + bbox[2]) / 2, (bbox[1] + bbox[3]) / 2
    x = F.radians(col(lon) - lon0) * (EARTH_M * math.cos(math.radians(lat0)))
    return x, F.radians(col(lat) - lat0) * EARTH_M


def mercator(lon: C, lat: C) -> tuple[Column, Column]:
    """Spherical Mercator (EPSG:3857), latitudes held within 85 degrees."""
    phi = F.radians(clamp(lat, -85, 85))
    return MERCATOR_M * F.radians(col(lon)), MERCATOR_M * F.log(F.tan(math.pi / 4 + phi / 2))


# GRS80 ellipsoid, and origins (latitude, longitude) of plane-rectangular zones by EPSG code.
GRS80_A, GRS80_F = 6_378_137.0, 1 / 298.257222101
ZONES = {6669: (33.0, 129.5), 6670: (33.0, 131.0), 6671: (36.0, 132.0 + 1 / 6), 6672: (33.0, 133.5), 6673: (36.0, 134.0 + 1 / 3), 6674: (36.0, 136.0), 6675: (36.0, 137.0 + 1 / 6)}


def _meridian(n: float, phi: float) -> float:
    """Rectifying meridian arc from the equator over the scaled radius, by the third flattening."""
    e = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi = math.atan2(t, 1.0)
    return xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(_series(n), 1))


def _series(n: float) -> list[float]:
    """Krueger's forward coefficients to the fourth order."""
    return [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]


def transverse_mercator(lon: C, lat: C, lat0: float, lon0: float, scale: float = 0.9999) -> tuple[Column, Column]:
    """Easting and northing in metres by Krueger's series on GRS80."""
    n = GRS80_F / (2 - GRS80_F)
    radius = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * math.sqrt(n) / (1 + n)
    s, dlon = F.sin(F.radians(col(lat))), F.radians(col(lon) - lon0)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_series(n), 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return scale * radius * x, scale * radius * (y - _meridian(n, math.radians(lat0)))


def project_lonlat(lon: C, lat: C, bbox: tuple[float, float, float, float], crs: str = "local") -> tuple[Column, Column]:
    """x and y by ``local`` (equirectangular), ``EPSG:3857`` or a plane-rectangular zone."""
    code = crs.rpartition(":")[2]
    if code == "3857":
        return mercator(lon, lat)
    if code.isdigit() and int(code) in ZONES:
        return transverse_mercator(lon, lat, *ZONES[int(code)])
    return equirectangular(lon, lat, bbox)


def in_bbox(lon: C, lat: C, bbox: tuple[float, float, float, float]) -> Column:
    west, south, east, north = map(float, bbox)
    return finite(lon) & finite(lat) & col(lon).between(west, east) & col(lat).between(south, north)


def haversine_km(lon1: C, lat1: C, lon2: C, lat2: C) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * EARTH_M / 1000 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def point_segment_distance(px: C, py: C, ax: C, ay: C, bx: C, by: C) -> Column:
    dx, dy = col(bx) - col(ax), col(by) - col(ay)
    size = dx * dx + dy * dy
    t = F.when(size > 0, clamp(((col(px) - col(ax)) * dx + (col(py) - col(ay)) * dy) / size, 0, 1)).otherwise(F.lit(0.0))
    return F.hypot(col(px) - col(ax) - t * dx, col(py) - col(ay) - t * dy)


def polyline_length_km(points: C) -> Column:
    """Of an array of structs with x and y in metres."""
    p = col(points)
    steps = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, s: a + s) / 1000.0


def trace_strike_deg(points: C) -> Column:
    """Azimuth from the first to the last point; 0 for fewer than two points."""
    p = col(points)
    first, last = F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(-1))
    return F.when(F.size(p) >= 2, F.pmod(F.degrees(F.atan2(last["x"] - first["x"], last["y"] - first["y"])), F.lit(360.0))).otherwise(F.lit(0.0))


def plane_to_strike_dip(nx: C, ny: C, nz: C) -> tuple[Column, Column]:
    """Of a normal, turned up; a flat plane has strike 0."""
    size = F.sqrt(col(nx) * col(nx) + col(ny) * col(ny) + col(nz) * col(nz)) + 1e-12
    sign = F.when(col(nz) < 0, -1.0).otherwise(1.0)
    x, y, z = (sign * col(c) / size for c in (nx, ny, nz))
    dip = F.degrees(F.acos(clamp01(F.abs(z))))
    strike = F.when(F.hypot(x, y) < 1e-9, 0.0).otherwise(F.pmod(F.degrees(F.atan2(-y, x)), F.lit(360.0)))
    return strike, clamp(dip, 0, 90)


def fault_rectangle(x: C, y: C, z: C, strike: C, dip: C, length_km: C, width_km: C) -> Column:
    """Four corners: top edge along strike, then the bottom edge back; z stays below the surface."""
    s, d = F.radians(col(strike)), F.radians(clamp(dip, 1, 89))
    ax, ay = F.sin(s) * col(length_km) * 500, F.cos(s) * col(length_km) * 500
    down = col(width_km) * 500
    ox, oy, oz = F.cos(s) * F.cos(d) * down, -F.sin(s) * F.cos(d) * down, F.sin(d) * down
    corner = lambda u, v: F.struct((col(x) + u * ax + v * ox).alias("x"), (col(y) + u * ay + v * oy).alias("y"), F.greatest(F.lit(0.0), col(z) + v * oz).alias("z"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
