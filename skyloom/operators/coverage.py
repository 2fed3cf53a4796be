"""Share of an area that a footprint covers, in azimuthal equidistant coordinates about the area's centre."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.geo import A, E2

#: Rounds of the geodesic's iteration; what has not settled by then lies close to the other side of the earth.
ROUNDS = 60


def geodesic(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length (km) and azimuth at the first point (rad) of the shortest lines on the ellipsoid between points in degrees.

    Vincenty's inverse solution ("Direct and Inverse Solutions of Geodesics on the Ellipsoid", 1975) for all pairs at once;
    NaN for points nearly opposite to each other, where it does not settle, and where a coordinate is missing.
    """
    f = 1 - np.sqrt(1 - E2)
    b = A * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(np.asarray(x, float)))) for x in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    wanted = np.radians(np.mod(np.asarray(lon2, float) - np.asarray(lon1, float) + 180, 360) - 180)
    lam, settled = wanted.copy(), np.zeros(wanted.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            sl, cl = np.sin(lam), np.cos(lam)
            east, north = c2 * sl, c1 * s2 - s1 * c2 * cl
            ss, cs = np.hypot(east, north), s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            alpha = np.where(ss > 0, c1 * c2 * sl / ss, 0.0)
            cos2 = 1 - alpha * alpha
            middle = np.where(cos2 > 0, cs - 2 * s1 * s2 / cos2, 0.0)
            c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = wanted + (1 - c) * f * alpha * (sigma + c * ss * (middle + c * cs * (2 * middle * middle - 1)))
            settled = np.abs(new - lam) < 1e-13
            lam = new
            if settled.all():
                break
        u = cos2 * (A * A - b * b) / (b * b)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        turn = small * ss * (middle + small / 4 * (cs * (2 * middle**2 - 1) - small / 6 * middle * (4 * ss * ss - 3) * (4 * middle**2 - 3)))
        ok = (np.abs(new - wanted) < np.pi) & (np.abs(lam) <= np.pi) & (settled | (ss == 0))
        return np.where(ok, b * big * (sigma - turn), np.nan), np.where(ok, np.arctan2(east, north), np.nan)


def equidistant(points: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """Lon and lat as kilometres east and north: distance and azimuth from the origin (one, or one a point) are true."""
    origin = np.broadcast_to(origin, points.shape)
    s, azimuth = geodesic(origin[:, 1], origin[:, 0], points[:, 1], points[:, 0])
    return np.stack([s * np.sin(azimuth), s * np.cos(azimuth)], axis=1)


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2) if len(ring) > 2 else 0.0


def clipped(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Sutherland-Hodgman: a ring cut by a convex, counter-clockwise window; bridges between parts cancel in the area."""
    for p, q in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(ring):
            return ring
        side = (q[0] - p[0]) * (ring[:, 1] - p[1]) - (q[1] - p[1]) * (ring[:, 0] - p[0])
        out = []
        for a, b, sa, sb in zip(ring, np.roll(ring, -1, axis=0), side, np.roll(side, -1), strict=True):
            if sa >= 0:
                out.append(a)
            if (sa >= 0) != (sb >= 0):
                out.append(a + (b - a) * (sa / (sa - sb)))
        ring = np.array(out) if out else np.zeros((0, 2))
    return ring


def crosses_itself(ring: np.ndarray) -> bool:
    """Whether two edges that aren't neighbours cross; a sweep from west to east, each edge against those that begin within its span."""
    n, after = len(ring), np.roll(ring, -1, axis=0)
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    west = np.minimum(ring[:, 0], after[:, 0])
    order = np.argsort(west)
    ends = np.searchsorted(west[order], np.maximum(ring[:, 0], after[:, 0])[order], side="right")
    for k, i in enumerate(order):
        j = order[k + 1 : ends[k]]
        j = j[((j - i) % n != 1) & ((i - j) % n != 1)]
        a, b, c, d = ring[i], after[i], ring[j], after[j]
        if ((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)).any():
            return True
    return False


def convex(ring: np.ndarray) -> bool:
    edge = np.roll(ring, -1, axis=0) - ring
    after = np.roll(edge, -1, axis=0)
    turn = edge[:, 0] * after[:, 1] - edge[:, 1] * after[:, 0]
    return bool((turn >= 0).all() or (turn <= 0).all())


def overlap(ring: np.ndarray, window: np.ndarray) -> float:
    """Area that two simple rings share. A window that isn't convex is taken as signed triangles about its first corner, each of them convex."""
    first = window[0]
    pieces = [window] if convex(window) else [np.stack([first, p, q]) for p, q in zip(window[1:-1], window[2:], strict=True)]
    total = 0.0
    for piece in pieces:
        own = area(piece)
        if own:
            total += np.sign(own) * abs(area(clipped(ring, piece if own > 0 else piece[::-1])))
    return abs(total)


def share(strip: np.ndarray, parts: list[tuple[np.ndarray, list[np.ndarray]]]) -> float | None:
    """Share of an area that a strip covers. The area's parts are outer rings with their holes, in kilometres; they don't overlap.

    At most 1, with 3 decimals; null for parts that are flat or cross themselves, and where a place could not be reckoned.
    """
    rings = [r for outer, holes in parts for r in (outer, *holes)]
    if len(strip) < 3 or not rings or any(len(r) < 3 for r in rings) or not all(np.isfinite(r).all() for r in (strip, *rings)):
        return None
    if crosses_itself(strip) or any(crosses_itself(r) for r in rings):
        return None
    signs = [1.0 if k == 0 else -1.0 for _, holes in parts for k in range(len(holes) + 1)]
    whole = sum(s * abs(area(r)) for s, r in zip(signs, rings, strict=True))
    if whole < 1e-9:
        return None
    return round(min(1.0, max(0.0, sum(s * overlap(r, strip) for s, r in zip(signs, rings, strict=True))) / whole), 3)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All points (lon, lat) of a column of rings, and how many each row has."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    number = lambda k: pc.cast(pc.struct_field(flat, k), pa.float64()).to_numpy(zero_copy_only=False)
    return np.stack([number("lon"), number("lat")], axis=1), sizes


def coverages(footprint: pa.Array, ring: pa.Array, lon: pa.Array, lat: pa.Array) -> pa.Array:
    """Of each row: all points of a batch are projected at once, each about the centre of its own area."""
    centre = np.stack([x.to_numpy(zero_copy_only=False).astype(float) for x in (lon, lat)], axis=1)
    placed = []
    for column in (footprint, ring):
        points, sizes = _lists(column)
        placed.append(np.split(equidistant(points, np.repeat(centre, sizes, axis=0)), np.cumsum(sizes)[:-1]) if len(sizes) else [])
    return pa.array([share(strip, [(own, [])]) for strip, own in zip(*placed, strict=True)], pa.float64())


def covered(footprint: list | None, ring: list | None) -> float | None:
    """The same of one pair of lists of {lon, lat}, about the ring's first corner."""
    kind = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
    first = ring[0] if ring else {"lon": None, "lat": None}
    return coverages(pa.array([footprint], kind), pa.array([ring], kind), pa.array([first["lon"]], pa.float64()), pa.array([first["lat"]], pa.float64()))[0].as_py()


def coverage(footprint: Column, ring: Column, lon: Column, lat: Column) -> Column:
    """Share of a ring <lon, lat> with its centre at lon and lat that a footprint covers; null where either is missing or not an area."""

    def run(footprint: pa.Array, ring: pa.Array, lon: pa.Array, lat: pa.Array) -> pa.Array:
        return coverages(footprint, ring, lon, lat)

    return F.arrow_udf(run, T.DoubleType())(footprint, ring, lon, lat)
