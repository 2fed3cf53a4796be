"""Pass prediction: when which satellite sees which area.

The search is pruned by an index of ground tracks. The window is cut into blocks of time, and these into runs of a few minutes.
A task takes a satellite and a block, computes its ephemeris on a coarse grid, and marks the cells of a global grid that come within reach
during each run; it also counts the steps whose propagation failed. Areas are keyed by their cell, so an equi-join gives the
(satellite, run, area) that can meet at all. Only these are scanned: local minima of the off-nadir angle, then their refinement, for
all areas of a satellite's run together. Marks are made with margins, so that no approach within reach is lost.

Gates, geometry and grades are column expressions, cheap gates first; only what passes them gets a footprint and a coverage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import geo, grading, sky
from skyloom.functions.sgp4 import orbit
from skyloom.functions.vectors import angle_deg, cross, dot, minus, norm, vec
from skyloom.operators.coverage import coverage
from skyloom.operators.minima import CUTOFF_DEG, SHRINK
from skyloom.sources.elements import epoch_us

STEP_S = 20.0
REFINE_STEPS = 13
#: Steps of a block, about a day at the usual step, and of a run, some minutes; shares into which a run's areas are dealt.
BLOCK_STEPS = 4320
RUN_STEPS = 15
GROUP_AREAS = 8
#: Cells are about this wide, in degrees. A mark's margin covers flattening, terrain and the two kinds of nadir.
CELL_DEG = 3.0
MARGIN_DEG = 0.75
LOWEST_KM = 6350.0
#: Rows of a roster that may be sent to every task.
MOST_SATELLITES = 100_000
FOUND = "t_us long, eta double, x double, y double, z double, vx double, vy double, vz double, err int, bad_steps long, codes long, block int"
GMST_AT = 946_728_000_000_000  # 2000-01-01T12:00 UTC, in microseconds


def gmst(us: np.ndarray) -> np.ndarray:
    d = (np.asarray(us, np.float64) - GMST_AT) / 86_400e6
    t = d / 36525
    return np.radians(np.mod(280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t**3 / 38710000, 360))


@lru_cache(maxsize=16)
def ephemeris(line1: str, line2: str, start_us: int, first: int, steps: int, step_us: int):
    us = start_us + step_us * np.arange(first, first + steps, dtype=np.int64)
    err, r, _ = orbit(line1, line2).at(us)
    return us, gmst(us), err, r


def off_nadir(r: np.ndarray, theta: np.ndarray, err: np.ndarray, site: np.ndarray, ellipsoid: bool = False) -> np.ndarray:
    """Angle at the satellite between nadir and a site (ECEF km), or a site a position, in degrees; 180 where there is no position."""
    c, s = np.cos(theta), np.sin(theta)
    ground = np.stack([c * site[..., 0] - s * site[..., 1], s * site[..., 0] + c * site[..., 1], np.broadcast_to(site[..., 2], c.shape)], axis=-1)
    look = ground - r
    down = -r
    if ellipsoid:
        p = np.hypot(r[:, 0], r[:, 1])
        b = geo.A * np.sqrt(1 - geo.E2)
        t = np.arctan2(r[:, 2] * geo.A, p * b)
        lat = np.arctan2(r[:, 2] + (geo.A**2 - b * b) / b * np.sin(t) ** 3, p - geo.E2 * geo.A * np.cos(t) ** 3)
        lon = np.arctan2(r[:, 1], r[:, 0])
        down = -np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)
    with np.errstate(invalid="ignore"):
        cosine = (down * look).sum(axis=1) / (np.linalg.norm(down, axis=1) * np.linalg.norm(look, axis=1))
    return np.where(err == 0, np.degrees(np.arccos(np.clip(cosine, -1, 1))), 180.0)


def closest(line1: str, line2: str, site: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, ellipsoid: bool) -> np.ndarray:
    """Golden-section minima of the off-nadir angle in brackets of microseconds, all brackets at once."""
    path = orbit(line1, line2)

    def f(us):
        err, r, _ = path.at(us)
        return off_nadir(r, gmst(us), err, site, ellipsoid)

    a, b = low.astype(np.float64), high.astype(np.float64)
    for _ in range(steps):
        c, d = b - SHRINK * (b - a), a + SHRINK * (b - a)
        left = f(c) < f(d)
        a, b = np.where(left, a, c), np.where(left, d, b)
    return np.rint((a + b) / 2).astype(np.int64)


@lru_cache(maxsize=1)
def cells(width: float) -> tuple[np.ndarray, float]:
    """Unit vectors of the centres of all cells, in order of their numbers, and the greatest angle from a centre to its cell's rim, in radians."""
    bands = round(180 / width)
    out, rim = [], 0.0
    for band in range(bands):
        low, high = -90 + 180 * band / bands, -90 + 180 * (band + 1) / bands
        lat, n = np.radians((low + high) / 2), _columns(band, bands)
        lon = np.radians(-180 + 360 * (np.arange(n) + 0.5) / n)
        out.append(np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.full(n, np.sin(lat))], axis=1))
        edge, half = np.radians(np.array([low, high])), np.pi / n
        rim = max(rim, float(np.arccos(np.clip(np.sin(edge) * np.sin(lat) + np.cos(edge) * np.cos(lat) * np.cos(half), -1, 1)).max()))
    return np.concatenate(out), rim


def _columns(band: int, bands: int) -> int:
    """Cells of a band of latitude: as wide as high at its edge nearer to the equator."""
    low, high = -90 + 180 * band / bands, -90 + 180 * (band + 1) / bands
    widest = 0.0 if low < 0 < high else min(abs(low), abs(high))
    return max(1, int(np.ceil(2 * bands * np.cos(np.radians(widest)))))


def cell_of(site, width: float = CELL_DEG):
    """Number of the cell of a site (ECEF), as a column."""
    bands = round(180 / width)
    counts = [_columns(b, bands) for b in range(bands)]
    first = np.concatenate(([0], np.cumsum(counts))).tolist()
    lat = F.degrees(F.atan2(site["z"], F.sqrt(site["x"] * site["x"] + site["y"] * site["y"])))
    lon = F.degrees(F.atan2(site["y"], site["x"]))
    band = F.least(F.greatest(F.floor((lat + 90) / 180 * bands), F.lit(0)), F.lit(bands - 1)).cast("int")
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), band)
    column = F.least(F.greatest(F.floor((lon + 180) / 360 * of(counts)), F.lit(0)), of(counts) - 1)
    return (of(first[:-1]) + column).cast("int")


def reach_rad(distance: np.ndarray, off_deg: float) -> np.ndarray:
    """Angle at the earth's centre from below a satellite to the farthest ground it sees within an off-nadir angle, or to the horizon."""
    eta = np.radians(min(off_deg, 90.0))
    sine = np.maximum(distance, LOWEST_KM) * np.sin(eta) / LOWEST_KM
    return np.where(sine < 1, np.arcsin(np.minimum(sine, 1)) - eta, np.arccos(np.minimum(LOWEST_KM / np.maximum(distance, LOWEST_KM), 1)))


def _blocks(batches: Iterator[pa.RecordBatch], start_us: int, steps: int, step_us: int, per: int) -> Iterator[tuple]:
    """With ``per`` steps a block: (batch, row, block, its first step and number of steps, ephemeris with a step more at each end, where that starts) of every row."""
    for batch in batches:
        for k, (line1, line2, block) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("line1", "line2", "block")], strict=True)):
            first, end = block * per, min(steps, (block + 1) * per)
            before = max(0, first - 1)
            yield batch, k, block, first, end - first, ephemeris(line1, line2, start_us, before, min(steps, end + 1) - before, step_us), before


def _marker(start_us: int, steps: int, step_us: int, per: int, off_deg: float):
    """For rows of a satellite and a block: the cells within reach in each run."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, rim = cells(CELL_DEG)
        for batch, k, _, first, count, (_, theta, err, r), before in _blocks(batches, start_us, steps, step_us, per):
            good = err == 0
            distance = np.where(good, np.linalg.norm(np.nan_to_num(r, nan=1.0), axis=1), 1.0)
            c, s = np.cos(theta), np.sin(theta)
            below = np.stack([c * r[:, 0] + s * r[:, 1], c * r[:, 1] - s * r[:, 0], r[:, 2]], axis=1) / distance[:, None]
            # Half a step's way over ground: the closest approach may lie between two steps.
            moved = np.arccos(np.clip((below[1:] * below[:-1]).sum(axis=1), -1, 1)) if len(below) > 1 else np.zeros(1)
            half = np.nanmax(moved, initial=0.0) / 2 if good.any() else 0.0
            cosine = np.cos(np.minimum(reach_rad(distance * 1.002, off_deg) + rim + half + np.radians(MARGIN_DEG), np.pi))
            runs, found = [], []
            for start in range(first, first + count, RUN_STEPS):
                end = min(start + RUN_STEPS, first + count)
                near = slice(max(start - 1 - before, 0), end + 1 - before)
                use = good[near]
                if use.any():
                    hit = np.flatnonzero((below[near][use] @ centres.T >= cosine[near][use][:, None]).any(axis=0))
                    found.append(hit)
                    runs.append(np.full(len(hit), start))
            n = sum(map(len, runs))
            if n:
                start = np.concatenate(runs)
                same = [batch.column(name).take(pa.array(np.full(n, k))) for name in ("satellite", "line1", "line2")]
                new = [start, np.minimum(start + RUN_STEPS, first + count) - start, np.concatenate(found)]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(v.astype(np.int32)) for v in new]], names=["satellite", "line1", "line2", "first", "count", "cell"])

    return mark


def _failer(start_us: int, steps: int, step_us: int, per: int):
    """For rows of a satellite and a block: how many of its steps failed, by error code."""

    def fail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, block, first, count, (_, _, err, _), before in _blocks(batches, start_us, steps, step_us, per):
            code, n = np.unique(err[first - before : first - before + count], return_counts=True)
            code, n = code[code != 0], n[code != 0]
            if len(code):
                yield pa.RecordBatch.from_arrays([batch.column("satellite").take(pa.array(np.full(len(code), k))), pa.array(np.full(len(code), block, np.int32)), pa.array(code.astype(np.int32)), pa.array(n)], names=["satellite", "block", "code", "n"])

    return fail


def _scanner(start_us: int, steps: int, step_us: int, per: int, ellipsoid: bool):
    """For rows of a satellite, a run and an area within reach: refined candidates."""
    names = ["aoi_id", "satellite", "t_us", "eta", "x", "y", "z", "vx", "vy", "vz", "err", "bad_steps", "codes", "block"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [batch.column(c).to_pylist() for c in ("line1", "line2")]
            start, count, sx, sy, sz = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "count", "sx", "sy", "sz"))
            sites, blocks = np.stack([sx, sy, sz], axis=1), start // per
            rows, parts = [], []
            for (line1, line2, block), own in groupby(range(batch.num_rows), key=lambda k: (lines[0][k], lines[1][k], blocks[k])):
                own = np.array(list(own))
                first = max(0, int(block) * per - 1)
                us, theta, err, r = ephemeris(line1, line2, start_us, first, min(steps, (int(block) + 1) * per + 1) - first, step_us)
                # A row's run with a step more at each end; steps beyond the window or the run count as no minimum.
                step = start[own][:, None] + np.arange(-1, RUN_STEPS + 1)
                there = (step >= 0) & (step < steps) & (step <= (start + count)[own][:, None])
                at = np.clip(step - first, 0, len(us) - 1)
                eta = off_nadir_of_runs(r, theta, err, at, sites[own])
                low = (eta[:, 1:-1] < eta[:, :-2]) & (eta[:, 1:-1] <= eta[:, 2:]) & (eta[:, 1:-1] < CUTOFF_DEG)
                area, k = np.nonzero(low & there[:, :-2] & there[:, 1:-1] & there[:, 2:])
                if not len(k):
                    continue
                # The brackets of all areas and runs are refined together.
                row, k = own[area], at[area, k + 1]
                t = closest(line1, line2, sites[row], us[k - 1], us[k + 1], REFINE_STEPS, ellipsoid)
                code, rr, vv = orbit(line1, line2).at(t)
                best = off_nadir(rr, gmst(t), code, sites[row], ellipsoid)
                rows.append(row)
                parts.append((t, best, *rr.T, *vv.T, code, np.zeros(len(t), np.int64), np.zeros(len(t), np.int64), np.full(len(t), block)))
            if not rows:
                continue
            took = pa.array(np.concatenate(rows).astype(np.int64))
            found = [np.concatenate(x) for x in zip(*parts, strict=True)]
            types = [pa.int64(), *[pa.float64()] * 7, pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            kept = [batch.column(c).take(took) for c in ("aoi_id", "satellite")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v).cast(kind) for v, kind in zip(found, types, strict=True)]], names=names)

    return scan


def off_nadir_of_runs(r: np.ndarray, theta: np.ndarray, err: np.ndarray, at: np.ndarray, sites: np.ndarray) -> np.ndarray:
    """``off_nadir`` from the earth's centre for sites (rows) at each one's own steps (columns)."""
    c, s = np.cos(theta), np.sin(theta)
    turned = np.stack([c * r[:, 0] + s * r[:, 1], c * r[:, 1] - s * r[:, 0], r[:, 2]], axis=1)
    d2 = (turned * turned).sum(axis=1)
    with np.errstate(invalid="ignore"):
        along = (turned[at] * sites[:, None, :]).sum(axis=2)
        slant = np.sqrt(np.maximum((sites * sites).sum(axis=1)[:, None] + d2[at] - 2 * along, 0))
        cosine = (d2[at] - along) / (np.sqrt(d2[at]) * slant)
    return np.where(err[at] == 0, np.degrees(np.arccos(np.clip(cosine, -1, 1))), 180.0)


def sent(table: DataFrame, rows: int = MOST_SATELLITES) -> DataFrame:
    """The table with a hint to send it to every task, if it has at most so many rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def _dealt(elements: DataFrame, steps: int) -> DataFrame:
    """A row a satellite and block of the window, dealt over many tasks: a few bytes say nothing of what they cost, so their number is explicit."""
    blocks = -(-steps // BLOCK_STEPS)
    rows = elements.select("satellite", "line1", "line2").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.repartition(_tasks(elements), "satellite", "block")


def _tasks(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def step_failures(elements: DataFrame, start_us: int, days: float, step_s: float = STEP_S) -> DataFrame:
    """(satellite, block, code, n): how many steps of each block failed, by error code."""
    steps = steps_of(days, step_s)
    kind = dict(elements.dtypes)["satellite"]
    return _dealt(elements, steps).mapInArrow(_failer(start_us, steps, int(step_s * 1e6), BLOCK_STEPS), f"satellite {kind}, block int, code int, n long")


def reachable(aois: DataFrame, elements: DataFrame, start_us: int, days: float, step_s: float = STEP_S, reach_deg: float = CUTOFF_DEG) -> DataFrame:
    """(aoi_id, site, satellite, run) that may meet: a satellite's run of steps marks the cells within reach, and areas are found by their cell."""
    steps = steps_of(days, step_s)
    areas = aois.select("aoi_id", geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("alt_km")).alias("s"))
    areas = areas.select("aoi_id", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"), F.col("s.z").alias("sz"), cell_of(F.col("s")).alias("cell"))
    kind = dict(elements.dtypes)["satellite"]
    marks = _dealt(elements, steps).mapInArrow(_marker(start_us, steps, int(step_s * 1e6), BLOCK_STEPS, reach_deg), f"satellite {kind}, line1 string, line2 string, first int, count int, cell int")
    return marks.join(areas, "cell").drop("cell")


def candidates(aois: DataFrame, elements: DataFrame, start_us: int, days: float, step_s: float = STEP_S, ellipsoid: bool = False, reach_deg: float = CUTOFF_DEG) -> DataFrame:
    """Refined closest approaches of (aoi_id, lon, lat, alt_km) and (satellite, line1, line2) within reach of an off-nadir angle and above the horizon.

    Others may be among them. Blocks with failed steps have a row besides, with error code 9, no area, their number of failed steps and a bit a code.
    """
    steps = steps_of(days, step_s)
    pairs = reachable(aois, elements, start_us, days, step_s, reach_deg)
    # A task shares a block's ephemeris among the areas it has.
    share = F.pmod(F.xxhash64("aoi_id"), F.lit(GROUP_AREAS))
    placed = pairs.repartition(_tasks(aois), "satellite", F.floor(F.col("first") / BLOCK_STEPS), share).sortWithinPartitions("satellite", "first")
    schema = f"aoi_id {dict(aois.dtypes)['aoi_id']}, satellite {dict(elements.dtypes)['satellite']}, {FOUND}"
    found = placed.mapInArrow(_scanner(start_us, steps, int(step_s * 1e6), BLOCK_STEPS, ellipsoid), schema)
    failed = step_failures(elements, start_us, days, step_s).groupBy("satellite", "block").agg(F.sum("n").alias("bad_steps"), F.bit_or(F.expr("shiftleft(1L, code)")).alias("codes"))
    none = {"t_us": F.lit(-1).cast("long"), "eta": F.lit(180.0), "err": F.lit(9), "bad_steps": F.col("bad_steps"), "codes": F.col("codes"), "block": F.col("block"), "satellite": F.col("satellite")}
    return found.unionByName(failed.select(*[none.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in found.schema]))


def predict(aois: DataFrame, elements: DataFrame, profile, start_us: int, days: float, step_s: float = STEP_S, ellipsoid: bool = False, include_nonoperational: bool = True, max_off: float | None = None, min_sun: float | None = None, marginal_off: float | None = None, marginal_sun: float | None = None, found: DataFrame | None = None) -> DataFrame:
    """Passes of (aoi_id, name, ring, lon, lat, alt_km) by (satellite, line1, line2, operational); one row a pass, with its bucket.

    Gates work on unrounded values; arguments win over the profile's envelope. ``found``: candidates already at hand.
    """
    given = lambda x, y: F.lit(float(y if x is None else x))
    usable = elements.where(F.col("operational") | F.lit(include_nonoperational))
    # Nothing beyond the widest gate can become a pass, so the search needs to reach no farther.
    reach = max(profile.max_off if max_off is None else max_off, profile.marginal_off if marginal_off is None else marginal_off)
    found = (candidates(aois, usable, start_us, days, step_s, ellipsoid, min(reach, CUTOFF_DEG)) if found is None else found).where("err = 0")
    t = F.col("t_us")
    j = sky.julian(t)
    full = found.join(aois, "aoi_id").join(sent(usable.select("satellite", "operational", epoch_us(F.col("line1")).alias("tle_epoch_us"))), "satellite")
    full = full.withColumns({"r": vec(F.col("x"), F.col("y"), F.col("z")), "v": vec(F.col("vx"), F.col("vy"), F.col("vz")), "theta": geo.gmst_rad(j["jd"] + j["fr"]), "site": geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("alt_km"))})
    full = full.withColumns({"ground": geo.ecef_to_teme(F.col("site"), F.col("theta")), "sat": geo.teme_to_ecef(F.col("r"), F.col("theta"))})
    full = full.withColumns({"look": minus(F.col("ground"), F.col("r")), "normal": cross(F.col("r"), F.col("v")), "rise": dot(minus(F.col("sat"), F.col("site")), geo.geodetic_up(F.col("lat"), F.col("lon")))})
    sign = F.when(dot(F.col("look"), F.col("normal")) < 0, -1.0).otherwise(1.0)
    seen = full.where("rise > 0").withColumns({"off": F.col("eta") * sign, "slant_range_km": norm(F.col("look")), "sun": sky.sun_position(t, F.col("lat"), F.col("lon"))}).drop("look", "normal", "rise", "ground")
    category = grading.access_tier(F.col("eta"), F.col("sun.elevation"), given(max_off, profile.max_off), given(min_sun, profile.min_sun), given(marginal_off, profile.marginal_off), given(marginal_sun, profile.marginal_sun))
    kept = seen.withColumn("category", category).where("category is not null")
    kept = geo.local_axes(kept.withColumn("ring_ecef", geo.ring_ecef(F.col("ring"), F.col("alt_km"))))
    kept = kept.withColumns({"moving": geo.ground_velocity(F.col("v"), F.col("theta"), F.col("sat")), "down": geo.nadir_unit(F.col("r"), F.col("theta"), F.lit(ellipsoid)), "ring_teme": F.transform("ring_ecef", lambda p: geo.ecef_to_teme(p, F.col("theta")))})
    kept = kept.withColumn("looks", F.transform("ring_teme", lambda p: minus(p, F.col("r")))).withColumn("max_off_nadir_aoi_deg", F.array_max(F.transform("looks", lambda p: angle_deg(F.col("down"), p))))
    kept = geo.with_footprint(geo.with_geometry(kept, profile.gsd_m), profile.swath_km, profile.agile, profile.max_off)
    age = (t - F.col("tle_epoch_us")) / 8.64e10
    out = kept.withColumns({"coverage_pct": coverage(F.col("footprint"), F.col("ring"), F.col("lon"), F.col("lat")), "quality": grading.quality_badge(F.col("eta"), F.col("sun.elevation")), "timing_sigma_s": grading.timing_sigma_s(age), "bucket": grading.bucket(F.col("category"), F.col("operational"))})
    pair = lambda v: F.array(F.round(v["lon"], 6), F.round(v["lat"], 6))
    return out.select(
        "aoi_id", "name", F.lit(profile.key).alias("sensor"), "satellite", t.alias("tca_us"), F.col("off").alias("off_nadir_deg"), F.col("sun.elevation").alias("sun_elev_deg"), "max_off_nadir_aoi_deg", "slant_range_km",
        "tle_epoch_us", "category", "operational", "bucket", "geometry.node", F.col("sun.solar_time").alias("local_solar_time_h"), "quality", "timing_sigma_s", "coverage_pct", F.transform("footprint", pair).alias("footprint_lonlat"), "geometry",
    )


def error_counts(found: DataFrame) -> DataFrame:
    """(satellite, bad_steps, codes): steps of the window whose propagation failed, and the sorted codes of the failures.

    Areas share a block's steps, so any area's count is that of all. ``codes`` of a candidate has a bit a code.
    """
    by_block = found.groupBy("satellite", "block").agg(F.max("bad_steps").alias("n"), F.bit_or("codes").alias("bits"))
    total = by_block.groupBy("satellite").agg(F.sum("n").alias("bad_steps"), F.bit_or("bits").alias("bits"))
    return total.select("satellite", "bad_steps", F.filter(F.array(*[F.lit(k) for k in range(1, 10)]), lambda c: F.getbit("bits", c) == 1).alias("codes"))


def error_histogram(failures: DataFrame) -> DataFrame:
    """(satellite, code, n) of ``step_failures``: failed steps of the window by error code."""
    return failures.groupBy("satellite", "code").agg(F.sum("n").alias("n"))


def steps_of(days: float, step_s: float = STEP_S) -> int:
    return int(days * 86400 / step_s) + 1


def warnings(found: DataFrame, elements: DataFrame, start_us: int, steps: int | None = None) -> DataFrame:
    """(ord, text): satellites whose propagation failed, at all of the window's ``steps`` or at some, then the age of the oldest element set, then the standing note."""
    failed = error_counts(found).where("bad_steps > 0")
    codes = F.concat_ws(", ", F.transform("codes", lambda c: c.cast("string")))
    some = F.format_string("%s: propagation failed at %d steps of the window (codes %s), so its passes are incomplete.", "satellite", "bad_steps", codes)
    none = F.format_string("%s: its element set can't be propagated at all (codes %s). It has no passes for that reason, not for want of opportunities.", "satellite", codes)
    failed = failed.select(F.lit(1).alias("ord"), F.when(F.col("bad_steps") == F.lit(steps), none).otherwise(some).alias("text"))
    age = F.max((F.lit(start_us) - epoch_us(F.col("line1"))) / 8.64e10)
    old = F.format_string("The most outdated element set precedes the window by %.1f days; times along the track grow uncertain.", "age")
    oldest = elements.agg(age.alias("age")).where("age is null or age > 3").select(F.lit(2).alias("ord"), F.coalesce(old, F.lit("None of the satellites asked for has an element set, so there are no passes.")).alias("text"))
    note = elements.sparkSession.range(1).select(F.lit(3).alias("ord"), F.lit("Times are as good as the element sets: their 1-sigma error is about (1 + 2 x age in days) / 7.5 s, so load new ones and predict again shortly before an order.").alias("text"))
    return failed.unionByName(oldest).unionByName(note)
