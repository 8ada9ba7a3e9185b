"""Planar geometry: projection, lines, bands, clipping of lines by polygons.

Scalars are Column expressions.  Kernels over arrays of points are numpy and run
inside Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Fixed values of the projection: WGS84 ellipsoid, UTM scale and false easting, zone 11.
A, INVERSE_F, K0, FALSE_EASTING, LON0 = 6378137.0, 298.257223563, 0.9996, 500000.0, -117.0
_N = 1 / (2 * INVERSE_F - 1)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series for the transverse Mercator projection, to the fourth order.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)

#: The inverse series, and conformal to geographic latitude, to the same order.
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def to_utm(lon: Column, lat: Column) -> Column:
    """struct(x, y): metres in UTM zone 11 north."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((FALSE_EASTING + K0 * _RADIUS * x).alias("x"), (K0 * _RADIUS * y).alias("y"))


def to_lonlat(x: Column, y: Column) -> Column:
    """struct(lon, lat) of a point in UTM zone 11 north."""
    xi, eta = y / (K0 * _RADIUS), (x - FALSE_EASTING) / (K0 * _RADIUS)
    north, east = xi, eta
    for j, b in enumerate(_BETA, 1):
        north = north - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(north) / F.cosh(east))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct((LON0 + F.degrees(F.atan2(F.sinh(east), F.cos(north)))).alias("lon"), F.degrees(phi).alias("lat"))


def length(points: Column) -> Column:
    """Length of a polyline given as array<struct<x, y>>."""
    steps = F.zip_with(
        F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], F.lit(2)) + F.pow(b["y"] - a["y"], F.lit(2))),
    )
    return F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + d)


def bearing(a: Column, b: Column) -> Column:
    """Direction in degrees, folded to 0-180."""
    return F.pmod(F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])), F.lit(180.0))


def angle_gap(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def bbox(points: Column) -> Column:
    xs, ys = points["x"], points["y"]
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")
    )


def band(box: Column, widest: float = 150.0) -> Column:
    """struct(axis, lo, hi) of the grid band that a run lies in; null if it wanders too far."""
    east_west = (box["x1"] - box["x0"]) >= (box["y1"] - box["y0"])
    lo, hi = F.when(east_west, box["y0"]).otherwise(box["x0"]), F.when(east_west, box["y1"]).otherwise(box["x1"])
    return F.when(hi - lo <= widest, F.struct(F.when(east_west, "EW").otherwise("NS").alias("axis"), lo.alias("lo"), hi.alias("hi")))


def ring_area(points: Column) -> Column:
    """Signed shoelace area: above zero for a counter-clockwise ring, which is a hole."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    cross = F.zip_with(
        F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    )
    return F.aggregate(cross, F.lit(0.0), lambda acc, d: acc + d) / 2


def cells(box: Column, size: float, margin: float = 0.0) -> Column:
    """array<struct<cx, cy>> of the grid cells that a box, widened by ``margin``, meets."""
    at = lambda v: F.floor(v / size)
    return F.flatten(
        F.transform(
            F.sequence(at(box["x0"] - margin), at(box["x1"] + margin)),
            lambda cx: F.transform(
                F.sequence(at(box["y0"] - margin), at(box["y1"] + margin)),
                lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")),
            ),
        )
    )


# ---- numpy kernels ---------------------------------------------------------


def inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd containment of points (n, 2) in closed rings."""
    out = np.zeros(len(points), dtype=bool)
    x, y = points[:, 0][:, None], points[:, 1][:, None]
    for ring in rings:
        x0, y0, x1, y1 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
        spans = (y0 > y) != (y1 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = x < (x1 - x0) * (y - y0) / (y1 - y0) + x0
        out ^= (np.sum(spans & cross, axis=1) % 2).astype(bool)
    return out


def _pairs_of(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row k the numbers first[k] .. first[k] + count[k] - 1, with k beside them."""
    own = np.repeat(np.arange(len(count)), count)
    return own, np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def clip_pairs(xy: np.ndarray, points: np.ndarray, edges: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parts of many lines inside their polygons, all at once: (pair, lo, hi, ax, ay, bx, by).

    xy: the points of all lines, one line after the other, ``points[k]`` of them for
    pair k; edges (n, 4): the ring edges of all polygons, ``own[k]`` of them for pair k.
    lo and hi are metres along the line.  Each segment is cut where it crosses an edge
    or where an edge along it ends; a part is inside if its middle is inside or on an
    edge, and parts that touch are one.
    """
    start = np.cumsum(points) - points
    pair, at = _pairs_of(start, np.maximum(points - 1, 0))
    a, d = xy[at], xy[at + 1] - xy[at]
    size = np.hypot(d[:, 0], d[:, 1])
    along = np.cumsum(size) - size
    first_of = np.searchsorted(pair, pair)  # along starts at 0 on every line
    along -= along[first_of] if len(along) else 0
    keep = size > 0
    pair, a, d, size, along = pair[keep], a[keep], d[keep], size[keep], along[keep]
    begin = np.cumsum(own) - own
    s, e = _pairs_of(begin[pair], own[pair])
    p, step = edges[e, :2], edges[e, 2:] - edges[e, :2]
    det = d[s, 0] * step[:, 1] - d[s, 1] * step[:, 0]
    w = p - a[s]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[:, 0] * step[:, 1] - w[:, 1] * step[:, 0]) / det
        u = (w[:, 0] * d[s, 1] - w[:, 1] * d[s, 0]) / det
    crossed = (det != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
    beside = (det == 0) & (np.abs(w[:, 0] * d[s, 1] - w[:, 1] * d[s, 0]) <= 1e-7 * size[s])
    cut_seg, cut_t = [np.arange(len(pair)), np.arange(len(pair)), s[crossed]], [np.zeros(len(pair)), np.ones(len(pair)), t[crossed]]
    for ends in (w[beside], w[beside] + step[beside]):
        on = s[beside]
        x = (ends * d[on]).sum(axis=1) / size[on] ** 2
        cut_seg.append(on[(x > 0) & (x < 1)])
        cut_t.append(x[(x > 0) & (x < 1)])
    seg, t = np.concatenate(cut_seg), np.concatenate(cut_t)
    order = np.lexsort((t, seg))
    seg, t = seg[order], t[order]
    k = np.flatnonzero((seg[1:] == seg[:-1]) & (t[1:] > t[:-1]))
    seg, t0, t1 = seg[k], t[k], t[k + 1]
    middle = a[seg] + d[seg] * ((t0 + t1) / 2)[:, None]
    m, e = _pairs_of(begin[pair[seg]], own[pair[seg]])
    x, y = middle[m, 0], middle[m, 1]
    x0, y0, x1, y1 = edges[e].T
    with np.errstate(divide="ignore", invalid="ignore"):
        over = ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    odd = np.bincount(m, over, len(seg)).astype(np.int64) % 2 == 1
    step = edges[e, 2:] - edges[e, :2]
    rel, length2 = middle[m] - edges[e, :2], (step**2).sum(axis=1)
    share = np.clip((rel * step).sum(axis=1) / np.where(length2 == 0, 1, length2), 0, 1)
    touches = ((rel - share[:, None] * step) ** 2).sum(axis=1) <= 1e-14
    held = odd | (np.bincount(m, touches, len(seg)) > 0)
    seg, t0, t1 = seg[held], t0[held], t1[held]
    if not len(seg):
        return (np.zeros(0, np.int64), *(np.zeros(0) for _ in range(6)))
    lo, hi = along[seg] + t0 * size[seg], along[seg] + t1 * size[seg]
    new = np.append(True, (pair[seg][1:] != pair[seg][:-1]) | (lo[1:] - hi[:-1] > 1e-9))
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(seg)) - 1
    from_, to = a[seg[i]] + d[seg[i]] * t0[i][:, None], a[seg[j]] + d[seg[j]] * t1[j][:, None]
    return pair[seg[i]], lo[i], hi[j], from_[:, 0], from_[:, 1], to[:, 0], to[:, 1]


def ring_distance(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Distance of two polygons: 0 if they meet or one holds the other."""
    if inside(a[0][:1], b).any() or inside(b[0][:1], a).any():
        return 0.0
    best = math.inf
    for ra in a:
        for rb in b:
            best = min(best, _edge_distance(ra, rb))
    return best


def _edge_distance(ra: np.ndarray, rb: np.ndarray) -> float:
    p, d = ra[:-1][:, None], np.diff(ra, axis=0)[:, None]
    q, e = rb[:-1][None], np.diff(rb, axis=0)[None]
    det = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
    w = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[..., 0] * e[..., 1] - w[..., 1] * e[..., 0]) / det
        u = (w[..., 0] * d[..., 1] - w[..., 1] * d[..., 0]) / det
    if ((det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any():
        return 0.0

    def to_edges(points, start, step):
        """Least distance of points (n, 2) to segments."""
        rel = points[:, None] - start[None]
        size = (step**2).sum(-1)
        at = np.clip((rel * step[None]).sum(-1) / np.where(size == 0, 1, size), 0, 1)
        gap = rel - at[..., None] * step[None]
        return float(np.sqrt((gap**2).sum(-1)).min())

    return min(to_edges(ra, rb[:-1], np.diff(rb, axis=0)), to_edges(rb, ra[:-1], np.diff(ra, axis=0)))
