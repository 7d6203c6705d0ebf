"""Distances and projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0  # fixed value


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle distance in km."""
    dlat = F.radians(lat2 - lat1) / 2
    dlng = F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def _krueger(n: float):
    return (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )


def transverse_mercator(lat: Column, lng: Column, lon0: Column, k0: float = 0.9996, east0: float = 500000.0,
                        north0: Column | float = 0.0, a: float = 6378137.0, inv_f: float = 298.257223563):
    """Krueger series to third order (sub-millimetre inside a zone); returns (easting, northing)."""
    f = 1 / inv_f
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = math.sqrt(f * (2 - f))
    phi, lam = F.radians(lat), F.radians(lng - lon0)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, alpha in enumerate(_krueger(n), start=1):
        east = east + alpha * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + alpha * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east0 + k0 * radius * east, north0 + k0 * radius * north


def to_utm(lat: Column, lng: Column):
    """UTM easting and northing on WGS 84, zone taken from the longitude."""
    zone = F.floor((lng + 180) / 6) + 1
    lon0 = zone * 6 - 183
    return transverse_mercator(lat, lng, lon0, north0=F.when(lat < 0, 10000000.0).otherwise(0.0))


def to_3006(lat: Column, lng: Column):
    """SWEREF99 TM: GRS80, central meridian 15, scale 0.9996, false easting 500000."""
    return transverse_mercator(lat, lng, F.lit(15.0), inv_f=298.257222101)


def polygon_area(ring: Column) -> Column:
    """Shoelace area of a vertex array<struct<x,y>>; the ring need not repeat its first point."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Ray cast with half-open edges: left and lower borders belong to the polygon."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    hits = F.zip_with(
        ring,
        following,
        lambda p, q: ((p["y"] > y) != (q["y"] > y))
        & (x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"]),
    )
    return F.aggregate(hits, F.lit(False), lambda acc, h: acc != F.coalesce(h, F.lit(False)))
