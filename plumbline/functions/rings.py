"""Verdicts on rings of bounded length, many rings of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

NOT_FINITE, DEGENERATE, NOT_COPLANAR, NOT_SIMPLE = 1, 2, 4, 8
MET_AT_ONCE = 1 << 20  # pairs of edges held in memory at a time


def segments_touch(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, tolerance: float) -> np.ndarray:
    """Which pairs of 2-D segments ``ab`` and ``cd``, arrays of shape ``(n, 2)``, cross, touch or overlap."""
    def turn(p, q, r):
        return (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])

    def on(p, q, r, turned, length):
        dx, dy = q[:, 0] - p[:, 0], q[:, 1] - p[:, 1]
        t = ((r[:, 0] - p[:, 0]) * dx + (r[:, 1] - p[:, 1]) * dy) / (length * length)
        return (t >= -tolerance / length) & (t <= 1 + tolerance / length) & (np.abs(turned / length) <= tolerance)

    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        first, second = np.hypot(*(b - a).T), np.hypot(*(d - c).T)
        scale = np.maximum(np.maximum(first, second), 1e-12) * tolerance
        opposite = lambda s, t: ((s > scale) & (t < -scale)) | ((s < -scale) & (t > scale))
        abc, abd, cda, cdb = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
        # a segment without length holds no point: divided by zero, nothing compares as near
        return ((opposite(abc, abd) & opposite(cda, cdb)) | ((first > 0) & (on(a, b, c, abc, first) | on(a, b, d, abd, first)))
                | ((second > 0) & (on(c, d, a, cda, second) | on(c, d, b, cdb, second))))


def _sweep(ring: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of edges along one axis inside their rings, and for each place how many later ones begin before this edge ends.

    ``low`` and ``high`` are shares of the ring's span, so numbers of different rings are four apart.
    """
    low, high = 4.0 * ring + np.clip(low, -0.5, 1.5), 4.0 * ring + np.clip(high, -0.5, 1.5)
    order = np.argsort(low, kind="stable")
    return order, np.searchsorted(low[order], high[order], side="right") - np.arange(len(order)) - 1


def _pairs(order: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges that meet in a sweep, no more than ``MET_AT_ONCE`` and one edge's at a time."""
    total = np.cumsum(counts)
    start, n = 0, len(order)
    while start < n:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + MET_AT_ONCE, side="right")))
        own = counts[start:stop]
        place = np.repeat(np.arange(start, stop), own)
        ahead = np.arange(len(place)) - np.repeat(np.cumsum(own) - own, own) + 1
        yield order[place], order[place + ahead]
        start = stop


def crossed_rings(points: np.ndarray, ring: np.ndarray, size: np.ndarray, boundary: float) -> np.ndarray:
    """Which rings have two edges that touch and are not neighbours.

    ``points`` holds all corners ``(x, y)`` in ring order, ``ring`` the number of each corner's ring, ``size`` the corners of each ring.
    Edges meet in a sweep along the axis on which fewer of the ring's edges overlap.
    """
    starts = np.cumsum(size) - size
    at = np.arange(len(points)) - starts[ring]
    following = np.where(at == size[ring] - 1, starts[ring], np.arange(len(points)) + 1)
    a, b = points, points[following]
    low, high = np.minimum(a, b), np.maximum(a, b)
    corner = np.minimum.reduceat(low, starts)
    span = (np.maximum.reduceat(high, starts) - corner).max(axis=1)
    pad = (boundary + 1e-9 * span)[ring, None]  # more than either test of nearness allows
    low, high = low - pad, high + pad
    share = lambda e: (e - corner[ring]) / span[ring, None]
    lows, highs = share(low), share(high)
    sweeps = [_sweep(ring, lows[:, k], highs[:, k]) for k in (0, 1)]
    met = np.stack([np.bincount(ring[order], counts, len(size)) for order, counts in sweeps])
    crossed = np.zeros(len(size), bool)
    for axis, (order, counts) in enumerate(sweeps):
        chosen = (met[1] < met[0]) == bool(axis)
        for e, g in _pairs(order, np.where(chosen[ring[order]], counts, 0)):
            other = 1 - axis
            keep = (low[e, other] <= high[g, other]) & (low[g, other] <= high[e, other])
            e, g = e[keep], g[keep]
            gap = np.abs(at[e] - at[g])
            apart = (gap > 1) & (gap != size[ring[e]] - 1)
            e, g = e[apart], g[apart]
            crossed[ring[e[segments_touch(a[e], b[e], a[g], b[g], boundary)]]] = True
    return crossed


def ring_faults(rings: pa.Array, planarity: float, boundary: float) -> np.ndarray:
    """A sum of the fault numbers above for each ring, a list of points that are lists of numbers."""
    faults = np.full(len(rings), NOT_FINITE, np.int32)
    rows = np.arange(len(rings))

    def left(keep: np.ndarray) -> None:
        nonlocal rows, rings
        rows, rings = rows[keep], rings.filter(pa.array(keep))

    lengths = lambda lists: pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    left(lengths(rings) >= 3)
    size = lengths(rings)
    owner = np.repeat(np.arange(len(rows)), size)
    left(np.bincount(owner, lengths(rings.flatten()) != 3, len(rows)) == 0)
    points = rings.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 3)  # null is not a number here
    size = lengths(rings)
    owner = np.repeat(np.arange(len(rows)), size)
    sound = np.bincount(owner, ~np.isfinite(points).all(axis=1), len(rows)) == 0
    points, size, rows = points[sound[owner]], size[sound], rows[sound]
    if not len(rows):
        return faults
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(rows)), size)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        last = starts + size - 1
        following = np.arange(len(points)) + 1
        following[last] = starts
        longest = np.maximum.reduceat(np.sqrt(((points[following] - points) ** 2).sum(axis=1)), starts)
        rel = points - points[starts][owner]
        fan = np.cross(rel, rel[following])  # the first corner is the origin: its own two products are nothing
        fan[last] = 0.0
        area = np.add.reduceat(fan, starts)
        length = np.sqrt((area * area).sum(axis=1))
        flat = length <= 1e-12 * longest * longest
        normal = area / length[:, None]
        axis = np.eye(3)[np.argmin(np.abs(normal), axis=1)]
        along = np.cross(axis, normal)
        along /= np.sqrt((along * along).sum(axis=1))[:, None]
        across = np.cross(normal, along)
        off = np.maximum.reduceat(np.abs((rel * normal[owner]).sum(axis=1)), starts)
        level = np.stack([(rel * v[owner]).sum(axis=1) for v in (along, across)], axis=1)
    coplanar = off <= planarity
    found = np.where(flat, DEGENERATE, np.where(coplanar, 0, NOT_COPLANAR))
    usable = ~flat & coplanar
    placed = np.logical_and.reduceat(np.isfinite(level).all(axis=1), starts)
    found[usable & ~placed] = NOT_SIMPLE  # too large for its plane to be computed: a rule that cannot be judged is not met
    usable &= placed
    if usable.any():
        number = np.cumsum(usable) - 1
        held = usable[owner]
        found[usable] = np.where(crossed_rings(level[held], number[owner[held]], size[usable], boundary), NOT_SIMPLE, 0)
    faults[rows] = found
    return faults


def faults_of(planarity: float, boundary: float) -> Callable[[Column], Column]:
    """A column function: the faults of an ``array<array<double>>`` ring."""
    @F.arrow_udf(T.IntegerType())
    def faults(rings: pa.Array) -> pa.Array:
        return pa.array(ring_faults(rings, planarity, boundary))

    return faults


def touch_of(boundary: float) -> Callable[[Column], Column]:
    """A column function: whether two segments touch, given as an array of their eight coordinates."""
    @F.arrow_udf(T.BooleanType())
    def touch(pairs: pa.Array) -> pa.Array:
        ends = pairs.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 2)
        return pa.array(segments_touch(*(ends[:, k] for k in range(4)), boundary))

    return touch
