"""Grids, windows and map projections as Column expressions.

Transverse Mercator is the Krueger series to third order; bounds are structs or
separate columns; nothing here needs a Python worker.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84, UTM, and the edge densification of a reprojected box.
A = 6378137.0
INVERSE_F = 298.257223563
K0 = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING = 10000000.0
EDGE_POINTS = 21

_f = 1 / INVERSE_F
_n = _f / (2 - _f)
RECTIFYING = A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
ALPHA = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16, 13 * _n**2 / 48 - 3 * _n**3 / 5, 61 * _n**3 / 240)
BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96, _n**2 / 48 + _n**3 / 15, 17 * _n**3 / 480)
DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3, 7 * _n**2 / 3 - 8 * _n**3 / 5, 56 * _n**3 / 15)
E1 = 2 * math.sqrt(_n) / (1 + _n)


def utm_zone(lon: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(60), (F.floor((lon + 180) / 6) + 1).cast("int")))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone; null outside 80 south to 84 north."""
    base = F.when(lat < 0, 32700).otherwise(32600)
    return F.when((lat >= -80) & (lat <= 84), base + utm_zone(lon))


def pick_utm_epsg(lon: float, lat: float) -> int:
    """The same on the driver; raises outside the UTM latitudes."""
    if not -80 <= lat <= 84:
        raise ValueError(f"latitude {lat} is outside the UTM range [-80, 84]")
    return (32700 if lat < 0 else 32600) + min(60, max(1, int((lon + 180) / 6) + 1))


def central_meridian(zone: Column) -> Column:
    return zone * 6.0 - 183.0


def utm_forward(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing (northing negative south of the equator)."""
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(zone))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(E1) * F.atanh(F.lit(E1) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + F.lit(a) * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        north = north + F.lit(a) * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    scale = F.lit(K0 * RECTIFYING)
    return F.lit(FALSE_EASTING) + scale * east, scale * north


def utm_inverse(east: Column, north: Column, zone: Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and a signed northing."""
    xi, eta = north / F.lit(K0 * RECTIFYING), (east - FALSE_EASTING) / F.lit(K0 * RECTIFYING)
    x, y = xi, eta
    for j, b in enumerate(BETA, 1):
        x = x - F.lit(b) * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
        y = y - F.lit(b) * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + F.lit(d) * F.sin(2.0 * j * chi)
    return central_meridian(zone) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def forward(lon: float, lat: float, zone: int) -> tuple[float, float]:
    """The forward series on the driver."""
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    s = math.sin(phi)
    t = math.sinh(math.atanh(s) - E1 * math.atanh(E1 * s))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    east = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    north = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    return FALSE_EASTING + K0 * RECTIFYING * east, K0 * RECTIFYING * north


def is_utm(epsg: int) -> bool:
    return 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760


def is_projected(epsg: int) -> bool:
    """Systems in metres that are known here."""
    return is_utm(epsg) or epsg in (3857, *ALBERS)


def project(lon: float, lat: float, epsg: int) -> tuple[float, float]:
    """Longitude and latitude to 4326, 3857, 3577, 5070 or a UTM code; other codes are refused."""
    x, y = transform(np.array([lon], float), np.array([lat], float), 4326, epsg)
    return float(x[0]), float(y[0])


# Centre, standard parallels and flattening's inverse of the Albers systems (a third parallel names the origin).
ALBERS = {
    3577: {"lon": 132.0, "lat": 0.0, "first": -18.0, "second": -36.0},
    5070: {"lon": -96.0, "lat": 23.0, "first": 29.5, "second": 45.5},
}


def _authalic(s: np.ndarray | float):
    """The q of the equal-area sphere for a sine of latitude."""
    return (1 - E1**2) * (s / (1 - (E1 * s) ** 2) + np.arctanh(E1 * s) / E1)


def _albers(epsg: int) -> tuple[float, float, float, float]:
    """Central meridian in radians, n, C and the radius at the origin (in semi-axes)."""
    p = ALBERS[epsg]
    m = lambda lat: math.cos(math.radians(lat)) / math.sqrt(1 - (E1 * math.sin(math.radians(lat))) ** 2)
    q = lambda lat: float(_authalic(math.sin(math.radians(lat))))
    n = (m(p["first"]) ** 2 - m(p["second"]) ** 2) / (q(p["second"]) - q(p["first"]))
    c = m(p["first"]) ** 2 + n * q(p["first"])
    return math.radians(p["lon"]), n, c, math.sqrt(c - n * q(p["lat"])) / n


def _to_degrees(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return np.degrees(x / A), np.degrees(2 * np.arctan(np.exp(y / A)) - math.pi / 2)
    if epsg in ALBERS:
        lon0, n, c, rho0 = _albers(epsg)
        u, v = x / A, rho0 - y / A
        sign = math.copysign(1.0, n)
        q = (c - (u * u + v * v) * n * n) / n
        s = q / _authalic(1.0)
        for _ in range(8):  # Newton steps on the sine of latitude
            s = np.clip(s - (_authalic(s) - q) * (1 - (E1 * s) ** 2) ** 2 / (2 * (1 - E1**2)), -1, 1)
        return np.degrees(lon0 + np.arctan2(sign * u, sign * v) / n), np.degrees(np.arcsin(s))
    if is_utm(epsg):
        xi, eta = (y - (FALSE_NORTHING if epsg > 32700 else 0)) / (K0 * RECTIFYING), (x - FALSE_EASTING) / (K0 * RECTIFYING)
        p = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
        h = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
        chi = np.arcsin(np.sin(p) / np.cosh(h))
        lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(DELTA, 1))
        return epsg % 100 * 6 - 183 + np.degrees(np.arctan2(np.sinh(h), np.cos(p))), np.degrees(lat)
    raise ValueError(f"EPSG:{epsg} is not supported; use 4326, 3857, 3577, 5070 or a UTM code")


def _from_degrees(lon: np.ndarray, lat: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return A * np.radians(lon), A * np.log(np.tan(math.pi / 4 + np.radians(lat) / 2))
    if epsg in ALBERS:
        lon0, n, c, rho0 = _albers(epsg)
        rho = np.sqrt(c - n * _authalic(np.sin(np.radians(lat)))) / n
        theta = n * (np.radians(lon) - lon0)
        return A * rho * np.sin(theta), A * (rho0 - rho * np.cos(theta))
    if is_utm(epsg):
        lam, s = np.radians(lon - (epsg % 100 * 6 - 183)), np.sin(np.radians(lat))
        t = np.sinh(np.arctanh(s) - E1 * np.arctanh(E1 * s))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
        east = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
        north = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
        return FALSE_EASTING + K0 * RECTIFYING * east, K0 * RECTIFYING * north + (FALSE_NORTHING if epsg > 32700 else 0)
    raise ValueError(f"EPSG:{epsg} is not supported; use 4326, 3857, 3577, 5070 or a UTM code")


def transform(x: np.ndarray, y: np.ndarray, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of one system in another (numpy arrays)."""
    return (x, y) if source == target else _from_degrees(*_to_degrees(x, y, source), target)


def project_ring(ring: list[tuple[float, float]], source: int, target: int, points: int = 21) -> list[tuple[float, float]]:
    """A ring in another system, with ``points`` more on each edge."""
    out: list[tuple[float, float]] = []
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        at = np.arange(points + 1) / (points + 1)
        x, y = transform(ax + (bx - ax) * at, ay + (by - ay) * at, source, target)
        out += list(zip(x.tolist(), y.tolist(), strict=True))
    return out


def crosses_itself(ring: list[tuple[float, float]]) -> bool:
    """Whether two sides of a ring that are not neighbours meet."""
    ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    sides = list(zip(ring, [*ring[1:], ring[0]], strict=True))
    n = len(sides)
    return any(_meet(*sides[i], *sides[j]) for i in range(n) for j in range(i + 2, n) if (j + 1) % n != i)


def densify(box: tuple[float, float, float, float], points: int = EDGE_POINTS) -> list[tuple[float, float]]:
    """A ring with ``points`` more on each edge; the box must have an area."""
    x0, y0, x1, y1 = box
    if x0 >= x1 or y0 >= y1:
        raise ValueError(f"box must have a positive area, got {box}")
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    out = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        out += [(ax + (bx - ax) * i / (points + 1), ay + (by - ay) * i / (points + 1)) for i in range(points + 1)]
    return out


def project_box(box: tuple[float, float, float, float], epsg: int, source: int = 4326) -> tuple[float, float, float, float]:
    """Envelope of a box of one system in another, its edges densified."""
    x, y = transform(*np.array(densify(box), float).T, source, epsg)
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())


def snap(minx: Column, miny: Column, maxx: Column, maxy: Column, res: float) -> list[Column]:
    """Bounds moved outward to multiples of the resolution."""
    r = F.lit(float(res))
    return [F.floor(minx / r) * r, F.floor(miny / r) * r, F.ceil(maxx / r) * r, F.ceil(maxy / r) * r]


def grid_size(low: Column, high: Column, res: float) -> Column:
    """Pixels of a side: half to even, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.bround((high - low) / F.lit(float(res))).cast("bigint"))


def window_in_grid(box: list[Column], minx: float, maxy: float, res: float, width: int, height: int) -> list[Column]:
    """col, row, width, height of a box in a grid, clamped; width or height 0 or less: no overlap."""
    x0, y0, x1, y1 = box
    r = F.lit(float(res))
    c0 = F.greatest(F.lit(0).cast("bigint"), F.floor((x0 - F.lit(float(minx))) / r))
    r0 = F.greatest(F.lit(0).cast("bigint"), F.floor((F.lit(float(maxy)) - y1) / r))
    c1 = F.least(F.lit(width).cast("bigint"), F.ceil((x1 - F.lit(float(minx))) / r))
    r1 = F.least(F.lit(height).cast("bigint"), F.ceil((F.lit(float(maxy)) - y0) / r))
    return [c0, r0, c1 - c0, r1 - r0]


def window_bounds(col: Column, row: Column, width: Column, height: Column, minx: float, maxy: float, res: float) -> list[Column]:
    """World box of a window."""
    r = F.lit(float(res))
    return [F.lit(float(minx)) + col * r, F.lit(float(maxy)) - (row + height) * r, F.lit(float(minx)) + (col + width) * r, F.lit(float(maxy)) - row * r]


def context_window(offset: Column, size: Column, least: int = 100) -> list[Column]:
    """A window side padded to at least ``least`` pixels around its middle, and where the
    original lies in it: new offset, new size, crop offset."""
    extra = F.greatest(F.lit(0).cast("bigint"), F.lit(least).cast("bigint") - size)
    before = F.floor(extra / 2)
    return [offset - before, size + extra, before]


def metres(minx: Column, miny: Column, maxx: Column, maxy: Column) -> list[Column]:
    """Width and height in metres of a box in degrees (111,111 m to a degree)."""
    middle = (miny + maxy) / 2.0
    return [(maxx - minx) * 111111.0 * F.cos(F.radians(middle)), (maxy - miny) * 111111.0]


def _meet(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    """Whether the closed segments ab and cd have a point in common."""
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return False
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


def polygons_meet(one: list[list[tuple[float, float]]], other: list[list[tuple[float, float]]]) -> bool:
    """Whether two polygons (rings, the first outside) touch or overlap."""
    edges = [[(a, b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)] for rings in (one, other)]
    if any(_meet(*e, *f) for e in edges[0] for f in edges[1]):
        return True

    def holds(sides: list[tuple], p: tuple[float, float]) -> bool:
        return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) for a, b in sides) % 2 == 1

    return holds(edges[1], one[0][0]) or holds(edges[0], other[0][0])


def clip_ring(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """The part of a ring inside a box, side by side (for convex results)."""
    x0, y0, x1, y1 = box
    sides = [(0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)]
    for axis, at, sign in sides:
        kept: list[tuple[float, float]] = []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            p_in, q_in = (p[axis] - at) * sign >= 0, (q[axis] - at) * sign >= 0
            if p_in:
                kept.append(p)
            if p_in != q_in:
                t = (at - p[axis]) / (q[axis] - p[axis])
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = kept
        if not ring:
            return []
    return ring
