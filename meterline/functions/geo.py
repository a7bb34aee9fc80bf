"""Plane geometry and map projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 and the national grid (transverse Mercator, central meridian 19 E).
A, FLAT = 6378137.0, 1 / 298.257222101
SCALE, MERIDIAN, EAST, NORTH = 0.9993, 19.0, 500000.0, -5300000.0
_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger series, forward, inverse and for the conformal latitude.
_FORWARD = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
_BACK = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
_LATITUDE = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630]


def _asinh(x: Column) -> Column:
    """Odd to the last bit: nothing cancels for large negative values."""
    return F.signum(x) * F.log(F.abs(x) + F.sqrt(x * x + 1))


def to_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of a WGS84 position (millimetres off within the zone). No quotient has a zero below it, at a
    pole or anywhere off the equator."""
    phi, lam = F.radians(lat), F.radians(lon - F.lit(MERIDIAN))
    k = 2 * math.sqrt(_N) / (1 + _N)
    bent = k * F.sin(phi)
    t = F.sinh(_asinh(F.tan(phi)) - k * F.log((1 + bent) / (1 - bent)) / 2)
    xi, eta = F.atan2(t, F.cos(lam)), _asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    north, east = xi, eta
    for j, a in enumerate(_FORWARD, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return EAST + SCALE * _RADIUS * east, NORTH + SCALE * _RADIUS * north


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a grid position."""
    xi, eta = (y - NORTH) / (SCALE * _RADIUS), (x - EAST) / (SCALE * _RADIUS)
    north, east = xi, eta
    for j, b in enumerate(_BACK, 1):
        north = north - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.atan2(F.sin(north), F.hypot(F.sinh(east), F.cos(north)))
    lat = chi
    for j, d in enumerate(_LATITUDE, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), MERIDIAN + F.degrees(F.atan2(F.sinh(east), F.cos(north)))


def on_globe(lat: Column, lon: Column) -> Column:
    """Whether a position has one way back from the grid: between the poles, and no further from the meridian than half a turn."""
    return (F.abs(lat) < 90) & (F.abs(lon - MERIDIAN) < 180)


def affine(m: list[list[float]], px: Column, py: Column) -> tuple[Column, Column]:
    """[px, py, 1] times a 3 x 2 matrix."""
    return tuple(px * m[0][i] + py * m[1][i] + m[2][i] for i in (0, 1))


def pixel_scale(m: list[list[float]]) -> tuple[float, float]:
    return math.hypot(*m[0]), math.hypot(*m[1])


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x0 - x1, y0 - y1)


def rectangle_distance(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    gap = lambda p, low, size: F.greatest(low - p, p - low - size, F.lit(0.0))
    return F.hypot(gap(x, left, width), gap(y, top, height))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the segment between two points."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / size))).otherwise(0.0)
    return F.hypot(x - ax - t * dx, y - ay - t * dy)


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.element_at(ring, (i + 1) % n + 1)["x"].alias("bx"), F.element_at(ring, (i + 1) % n + 1)["y"].alias("by")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a polygon (array of struct x, y, closed or not)."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    return F.size(F.filter(_edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def ring_area(ring: Column) -> Column:
    """The area within a ring, negative if it runs clockwise."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda a, e: a + (e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2)


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """From a point to a polygon (array of struct x, y, closed or not): 0 inside."""
    return F.when(in_ring(x, y, ring), F.lit(0.0)).otherwise(F.array_min(F.transform(_edges(ring), lambda e: segment_distance(x, y, e["ax"], e["ay"], e["bx"], e["by"]))))


def scale_04(pressure: Column, cuts: tuple[float, float, float]) -> Column:
    """Pressure on a scale of 0 to 4, linear between the cuts; twice the last cut is 4."""
    knots = [0.0, *cuts, 2 * cuts[-1]]
    out = F.lit(4.0)
    for i in range(len(knots) - 1, 0, -1):
        out = F.when(pressure <= knots[i], i - 1 + (pressure - knots[i - 1]) / (knots[i] - knots[i - 1])).otherwise(out)
    return out


def smooth(hour: Column, xs: list[float], ys: list[Column]) -> Column:
    """A monotone cubic through the points; slopes are harmonic means, 0 at the ends and at extremes; constant outside."""
    rise = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(len(xs) - 1)]
    slope = [F.lit(0.0), *[F.when(a * b > 0, 2 / (1 / F.nullif(a, F.lit(0.0)) + 1 / F.nullif(b, F.lit(0.0)))).otherwise(0.0) for a, b in zip(rise, rise[1:])], F.lit(0.0)]
    out = ys[-1]
    for i in range(len(xs) - 2, -1, -1):
        w = xs[i + 1] - xs[i]
        t = (hour - xs[i]) / w
        u = 1 - t
        piece = ys[i] * u * u * (1 + 2 * t) + ys[i + 1] * t * t * (3 - 2 * t) + w * (slope[i] * t * u * u - slope[i + 1] * t * t * u)
        out = F.when(hour <= xs[i + 1], piece).otherwise(out)
    return F.when(hour <= xs[0], ys[0]).otherwise(out)
