"""Rings that cross themselves, of any length."""

import numpy as np

from skyloom.operators import coverage


def plain(ring):
    n = len(ring)
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            a, b, c, d = ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


def test_sweep_matches_every_pair():
    rng = np.random.default_rng(5)
    found = []
    for n in range(3, 9):
        for _ in range(60):
            ring = rng.integers(0, 6, (n, 2)).astype(float)
            found.append(coverage.crosses_itself(ring))
            assert found[-1] == plain(ring)
    assert 0 < sum(found) < len(found)


def test_long_rings_are_tested_too():
    t = np.linspace(0, 2 * np.pi, 1001)[:-1] + 0.001
    points = lambda x, y: [{"lon": float(a), "lat": float(b)} for a, b in zip(x, y, strict=True)]
    window = points([-1, 1, 1, -1], [-1, -1, 1, 1])
    eight = points(0.1 * np.sin(t) * (1 + 0.3 * (np.sin(t) > 0)), 0.1 * np.sin(2 * t))
    assert coverage.covered(window, eight) is None
    assert coverage.covered(window, points(0.1 * np.cos(t), 0.1 * np.sin(t))) == 1.0


def test_geodesics_against_published_figures():
    s, azimuth = coverage.geodesic(np.array([40.6, 0.0, 10.0, 0.0]), np.array([-73.8, 0.0, 20.0, 0.0]), np.array([51.6, 0.0, 10.0, 0.3]), np.array([-0.5, 1.0, 20.0, 179.9]))
    assert abs(s[0] - 5551.759400319) < 1e-6 and abs(np.degrees(azimuth[0]) - 51.198882845579824) < 1e-9
    assert abs(s[1] - 6378.137 * np.pi / 180) < 1e-9 and s[2] == 0 and np.isnan(s[3])  # along the equator, no way at all, and nearly the other side


def surface(lon, lat):
    lon, lat = np.radians(lon), np.radians(lat)
    w = coverage.A / np.sqrt(1 - coverage.E2 * np.sin(lat) ** 2)
    return np.stack([w * np.cos(lat) * np.cos(lon), w * np.cos(lat) * np.sin(lon), w * (1 - coverage.E2) * np.sin(lat)], axis=-1)


def within(places, ring):
    """Even or odd crossings of a plane through the earth's centre, for places and a ring given on the surface."""
    up = places @ np.array([0.0, 0.0, 1.0])
    middle = surface(*np.mean(ring, axis=0))
    east = np.cross([0, 0, 1], middle)
    north = np.cross(middle, east)
    flat = lambda x: np.stack([x @ east / np.linalg.norm(east), x @ north / np.linalg.norm(north)], axis=-1) / (x @ middle / np.linalg.norm(middle))[..., None]
    p, q = flat(places), flat(surface(*np.array(ring).T))  # lines through the centre stay straight in this view
    inside = np.zeros(up.shape, bool)
    for a, b in zip(q, np.roll(q, -1, axis=0), strict=True):
        cross = (a[1] > p[..., 1]) != (b[1] > p[..., 1])
        with np.errstate(all="ignore"):
            inside ^= cross & (p[..., 0] < (b[0] - a[0]) * (p[..., 1] - a[1]) / (b[1] - a[1]) + a[0])
    return inside


def integrated(strip, parts):
    """Covered share by summing the ellipsoid's surface over a fine grid."""
    corners = np.array([p for outer, _ in parts for p in outer])
    (west, south), (east, north) = corners.min(axis=0) - 0.3, corners.max(axis=0) + 0.3
    n = 1500
    lon, lat = np.meshgrid(west + (east - west) * (np.arange(n) + 0.5) / n, south + (north - south) * (np.arange(n) + 0.5) / n)
    weight = np.cos(np.radians(lat)) / (1 - coverage.E2 * np.sin(np.radians(lat)) ** 2) ** 2
    places = surface(lon, lat)
    own = np.zeros(lon.shape, bool)
    for outer, holes in parts:
        inside = within(places, outer)
        for hole in holes:
            inside &= ~within(places, hole)
        own |= inside
    return (weight * (own & within(places, strip))).sum() / (weight * own).sum()


BOX = [(10.0, 50.0), (17.0, 50.0), (17.0, 54.5), (10.0, 54.5)]  # about 500 km on a side
ELL = [(10.0, 50.0), (17.0, 50.0), (17.0, 52.0), (13.0, 52.0), (13.0, 54.5), (10.0, 54.5)]
BAY = [(9.0, 49.0), (18.0, 49.5), (18.0, 55.0), (14.5, 55.0), (14.0, 51.0), (12.0, 51.5), (12.0, 55.0), (9.0, 55.0)]


def test_share_agrees_with_an_integration_over_the_ellipsoid():
    cases = [
        ([(11.0, 48.0), (14.0, 48.5), (16.0, 56.0), (12.5, 56.0)], [(BOX, [])]),
        ([(11.0, 48.0), (14.0, 48.5), (16.0, 56.0), (12.5, 56.0)], [(ELL, [])]),
        (BAY, [(BOX, [])]),
        (BAY, [(ELL, [[(11.0, 51.0), (12.5, 51.0), (12.5, 53.5), (11.0, 53.0)]])]),
        ([(8.0, 51.0), (20.0, 52.5), (20.0, 54.0), (8.0, 53.0)], [(BOX, [[(12.0, 51.0), (15.0, 51.0), (15.0, 54.0), (12.0, 53.5)]]), ([(18.0, 51.0), (19.5, 51.5), (19.0, 53.5)], [])]),
    ]
    for strip, parts in cases:
        centre = np.mean([p for outer, _ in parts for p in outer], axis=0)
        flat = lambda ring: coverage.equidistant(np.array(ring), centre)
        got = coverage.share(flat(strip), [(flat(outer), [flat(h) for h in holes]) for outer, holes in parts])
        want = integrated(strip, parts)
        assert 0.1 < want < 0.9 and abs(got - want) <= 1e-3


def test_a_column_of_pairs_with_missing_and_flat_ones(spark):
    corner = lambda points: [{"lon": float(x), "lat": float(y)} for x, y in points]
    half = corner([(10, 49), (13.5, 49), (13.5, 56), (10, 56)])
    rows = [(1, half, corner(BOX), 13.5, 52.0), (2, None, corner(BOX), 13.5, 52.0), (3, half, None, 13.5, 52.0), (4, half, corner(BOX), None, 52.0), (5, half, corner(BOX[:2]), 13.5, 52.0), (6, half, corner([(10, 50), (10, 52), (10, 51)]), 10.0, 51.0), (7, half, corner([BOX[0], BOX[2], BOX[1], BOX[3]]), 13.5, 52.0), (8, corner(BAY), corner(BOX), 13.5, 52.0)]
    table = spark.createDataFrame(rows, "k int, footprint array<struct<lon:double,lat:double>>, ring array<struct<lon:double,lat:double>>, lon double, lat double")
    got = {r["k"]: r["c"] for r in table.select("k", coverage.coverage(*[table[c] for c in ("footprint", "ring", "lon", "lat")]).alias("c")).collect()}
    assert abs(got[1] - 0.5) < 0.002 and [got[k] for k in (2, 3, 4, 5, 6, 7)] == [None] * 6 and 0.3 < got[8] < 1
    empty = table.where("k > 99")
    assert empty.select(coverage.coverage(*[empty[c] for c in ("footprint", "ring", "lon", "lat")]).alias("c")).collect() == []
