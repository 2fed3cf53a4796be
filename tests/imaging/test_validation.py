"""Scenes matched by shared tracks, against propagating the whole span of each."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.functions import sgp4
from skyloom.operators import passes, validation

from .test_orbits import element_set

SPAN = np.arange(-validation.SPAN_US, validation.SPAN_US + 1, validation.STEP_US)
HALF_DAY = ("1 09880U 77021A   06176.56157475  .00000421  00000-0  10000-3 0  9814", "2 09880  64.5968 349.3786 7069051 270.0229  16.3320  2.00813614112380")
DECAYED = ("1 28872U 05037B   05333.02012661  .25992681  00000-0  24476-3 0  1534", "2 28872  96.4736 157.9986 0303955 244.0492 110.6523 16.46015938 10708")


def scenes(pair, n, seed):
    rng = np.random.default_rng(seed)
    t = sgp4.orbit(*pair).epoch_us + rng.integers(-2 * 86_400_000_000, 2 * 86_400_000_000, n)
    lat, lon = np.radians(rng.uniform(-90, 90, n)), np.radians(rng.uniform(-180, 180, n))
    sites = 6371 * np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
    err, r, _ = sgp4.orbit(*pair).at(t[: n // 2])  # half of the sites are right below
    c, s = np.cos(passes.gmst(t[: n // 2])), np.sin(passes.gmst(t[: n // 2]))
    below = np.stack([c * r[:, 0] + s * r[:, 1], c * r[:, 1] - s * r[:, 0], r[:, 2]], axis=1)
    sites[: n // 2] = np.where((err == 0)[:, None], 6371 * below / np.linalg.norm(below, axis=1)[:, None], sites[: n // 2])
    return t, sites


def whole(pair, t, sites):
    us = t[:, None] + SPAN
    err, pos, _ = sgp4.orbit(*pair).at(us.ravel())
    return passes.off_nadir(pos, passes.gmst(us.ravel()), err, np.repeat(sites, len(SPAN), axis=0)).reshape(us.shape).argmin(axis=1)


@pytest.mark.parametrize("pair", [element_set(99001, 40, 72), element_set(99002, 10, 5, 51.6, 15.9), HALF_DAY, DECAYED])
def test_steps_are_those_of_the_whole_span(pair):
    t, sites = scenes(pair, 1500, 3)
    got = validation._nearest_steps(pair, t, sites)
    assert (got[got >= 0] == whole(pair, t, sites)[got >= 0]).all()
    if pair[0][2:7] in ("99001", "99002"):
        assert (got >= 0).mean() > 0.95
    if pair == DECAYED:
        assert (got < 0).any()


def test_scenes_share_a_track(monkeypatch):
    pair = element_set(99001, 40, 72)
    t, sites = scenes(pair, 2000, 4)
    columns = {"platform": ["p"] * len(t), "t_us": t, "tle_age_days": np.zeros(len(t)), "line1": [pair[0]] * len(t), "line2": [pair[1]] * len(t), **dict(zip(("sx", "sy", "sz"), sites.T, strict=True))}
    batch, points, at = pa.RecordBatch.from_pydict(columns), [], sgp4.Orbit.at
    validation._track.cache_clear()
    monkeypatch.setattr(sgp4.Orbit, "at", lambda self, us: (points.append(len(us)), at(self, us))[1])
    (found,) = validation._nearest(iter([batch]))
    assert sum(points) < 60 * len(t)  # it was 241 and 33 a scene
    step = whole(pair, t, sites)
    inside = (step > 0) & (step < len(SPAN) - 1)
    best = passes.closest(*pair, sites[inside], t[inside] + SPAN[step[inside] - 1], t[inside] + SPAN[step[inside] + 1], validation.STEPS, False)
    assert sorted(zip(found["t_us"].to_pylist(), found["predicted_us"].to_pylist(), strict=True)) == sorted(zip(t[inside].tolist(), best.tolist(), strict=True))


def test_matches_are_made_once(spark):
    pair = element_set(49260, 10, 20)
    start = sgp4.orbit(*pair).epoch_us
    seen = spark.range(300).select(F.lit("landsat-9").alias("platform"), (F.lit(start) + F.col("id") * 400_000_000).alias("t_us"), (F.col("id") % 120 - 60.0).alias("lat"), (F.col("id") * 7 % 360 - 180.0).alias("lon"))
    sets = spark.createDataFrame([("LANDSAT9", *pair)], "satellite string, line1 string, line2 string")
    out = validation.timing(seen, sets)
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = [r["dt_s"] for r in validation.scene_matches(seen, sets).collect()]
    assert {r["platform"]: r["n"] for r in out.collect()} == {"landsat-9": len(rows), None: len(rows)}
