"""Distances, speeds and projections as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
#: How a grade slows a walk (most speed at a fall of BEST), and a climb or a descent of stairs.
DECAY, BEST = 3.5, 0.05
STAIRS_UP, STAIRS_DOWN = 2.2, 1.6


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dp) * F.sin(dp) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dl) * F.sin(dl)
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def walk_minutes(metres: Column, km_h: float = 4.0, detour: float = 1.35) -> Column:
    return metres * detour / (km_h * 1000 / 60)


def tobler_speed(grade: Column, level: float = 1.0) -> Column:
    """Walking speed on a slope, as a multiple of the speed on level ground; the grade counts within -1..1."""
    g = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), grade))
    return level * F.exp(-DECAY * F.abs(g + BEST)) / math.exp(-DECAY * BEST)


def stair_speed(grade: Column, level: float = 1.0) -> Column:
    return level / (1 + STAIRS_UP * F.greatest(grade, F.lit(0.0)) + STAIRS_DOWN * F.greatest(-grade, F.lit(0.0)))


def pace(grade: Column, stairs: Column, level: float = 1.0) -> Column:
    """Time per metre: stairs or slope."""
    return F.when(stairs, 1 / stair_speed(grade, level)).otherwise(1 / tobler_speed(grade, level))


def unit_time(metres: Column, grade: Column, decay: float, stairs: Column | None = None) -> Column:
    """Time at level speed 1: exponential decay by the grade (0: a flat model); on stairs the stairs' own speed."""
    g = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), grade))
    slope = metres * F.exp(decay * (F.abs(g + BEST) - BEST))
    return slope if stairs is None else F.when(stairs, metres / stair_speed(g)).otherwise(slope)


def relative_pace(grade: np.ndarray, stairs: np.ndarray) -> np.ndarray:
    """`pace` at level speed 1 over arrays."""
    g = np.clip(grade, -1, 1)
    return np.where(stairs, 1 + STAIRS_UP * np.maximum(g, 0) + STAIRS_DOWN * np.maximum(-g, 0), np.exp(DECAY * (np.abs(g + BEST) - BEST)))


def mercator(lat: Column, lon: Column, size: float = 256.0) -> tuple[Column, Column]:
    """Web-Mercator world coordinates, 0..size."""
    s = F.sin(F.radians(lat))
    return (lon + 180) / 360 * size, (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * size


def local_xy(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin, by the ellipsoid's series for one degree."""
    p = math.radians(lat0)
    per_lat = 111132.92 - 559.82 * math.cos(2 * p) + 1.175 * math.cos(4 * p)
    per_lon = 111412.84 * math.cos(p) - 93.5 * math.cos(3 * p)
    return (lon - lon0) * per_lon, (lat - lat0) * per_lat


def from_local_xy(x: Column, y: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Latitude and longitude of metres east and north of an origin: the inverse of local_xy."""
    p = math.radians(lat0)
    per_lat = 111132.92 - 559.82 * math.cos(2 * p) + 1.175 * math.cos(4 * p)
    per_lon = 111412.84 * math.cos(p) - 93.5 * math.cos(3 * p)
    return y / per_lat + lat0, x / per_lon + lon0


def ring_area(ring: Column) -> Column:
    """Shoelace area of array<struct<x, y>>, closed or not."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: ring[i].x * ring[(i + 1) % n].y - ring[(i + 1) % n].x * ring[i].y)
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: true where (x, y) is inside array<struct<x, y>>."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = ring[i], ring[(i + 1) % n]
        return ((a.y > y) != (b.y > y)) & (x < (b.x - a.x) * (y - a.y) / F.nullif(b.y - a.y, F.lit(0.0)) + a.x)

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))) % 2 == 1
