"""Predictions against published scenes, and element sets against each other."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom import catalog
from skyloom.catalog import PLATFORMS
from skyloom.functions import geo, sky
from skyloom.functions.sgp4 import orbit
from skyloom.operators import skill
from skyloom.operators.ordered import lagged
from skyloom.operators.passes import closest, gmst, off_nadir
from skyloom.session import stored
from skyloom.sources import weather
from skyloom.sources.elements import BLOCK_US, MANOEUVRE_KM_PER_DAY, SPEED_KM_S, epoch_us, for_roster, parse_3le

SPAN_US, STEP_US, STEPS = 1_200_000_000, 10_000_000, 16
MAX_AGE_DAYS = 2.0
#: Scenes of a satellite that are propagated as one array: over their whole span, and in the refinement.
TOGETHER, REFINED = 256, 4096
#: The time a satellite's track is computed for at once, the distance of its points, in steps, and how many make up a value between two.
TRACK_US, POINT_STEPS, TAPS = 6 * sky.HOUR_US, 6, 12
POINT_US, BEFORE = POINT_STEPS * STEP_US, TAPS // 3
#: A track is used if it is that true between its points (km). Steps whose cosines are so close, or nearer ones (km), are left to the propagation.
TRUE_KM, CLOSE, NEAREST_KM = 1e-7, 1e-7, 50.0


def _weights(x: np.ndarray) -> np.ndarray:
    """Lagrange weights at ``x``, in points from the point ``BEFORE`` after the first, of TAPS points."""
    at = np.arange(TAPS) - BEFORE
    out = np.ones((*x.shape, TAPS))
    for c in range(TAPS):
        for other in range(TAPS):
            if other != c:
                out[..., c] *= (x - at[other]) / (at[c] - at[other])
    return out


@lru_cache(maxsize=32)
def _track(line1: str, line2: str, block: int) -> np.ndarray | None:
    """Positions (ECEF) of all points that scenes of a block of time need; None if they don't give those in between."""
    per, reach = TRACK_US // POINT_US, SPAN_US // POINT_US
    points = np.arange(block * per - reach - BEFORE, (block + 1) * per + reach + TAPS - BEFORE, dtype=np.int64)
    us = np.concatenate([points * POINT_US, points[:-1] * POINT_US + POINT_US // 2])
    err, r, _ = orbit(line1, line2).at(us)
    theta = gmst(us)
    c, s = np.cos(theta), np.sin(theta)
    turned = np.stack([c * r[:, 0] + s * r[:, 1], c * r[:, 1] - s * r[:, 0], r[:, 2]], axis=1)
    held, between = turned[: len(points)], turned[len(points) :]
    if err.any():
        return None
    w = _weights(np.array([0.5, 1.5]))
    there = np.lib.stride_tricks.sliding_window_view(held, TAPS, axis=0) @ w.T
    n = len(there)
    off = [np.abs(there[:, :, k] - between[BEFORE + k : BEFORE + k + n]).max() for k in (0, 1)]
    return held if max(off) < TRUE_KM else None


def _nearest_steps(pair: tuple[str, str], t: np.ndarray, sites: np.ndarray) -> np.ndarray:
    """The step of the span of each scene with the least off-nadir angle, from the satellite's track; -1 where that can't tell."""
    steps = 2 * SPAN_US // STEP_US + 1
    out = np.full(len(t), -1)
    blocks, points = t // TRACK_US, 2 * SPAN_US // POINT_US + 1
    for block in np.unique(blocks):
        track = _track(*pair, int(block))
        if track is None:
            continue
        d2 = (track * track).sum(axis=1)
        every = np.flatnonzero(blocks == block)
        for own in np.array_split(every, -(-len(every) // TOGETHER)):
            at = t[own] // POINT_US - block * (TRACK_US // POINT_US)
            where = at[:, None] + np.arange(points + TAPS - 1)
            along, square = np.einsum("nkc,nc->nk", track[where], sites[own]), d2[where]
            site2 = (sites[own] * sites[own]).sum(axis=1)[:, None]
            cosine, near = np.empty((len(own), points, POINT_STEPS)), np.zeros(len(own), bool)
            for p in range(POINT_STEPS):
                w = _weights((t[own] % POINT_US + p * STEP_US) / POINT_US)
                a = sum(w[:, c, None] * along[:, c : c + points] for c in range(TAPS))
                d = sum(w[:, c, None] * square[:, c : c + points] for c in range(TAPS))
                slant2 = site2 + d - 2 * a
                near |= (slant2 < NEAREST_KM**2).any(axis=1)
                cosine[:, :, p] = (d - a) / np.sqrt(d * np.maximum(slant2, 1.0))
            cosine = cosine.reshape(len(own), -1)[:, :steps]
            alone = (cosine >= cosine.max(axis=1)[:, None] - CLOSE).sum(axis=1) == 1
            out[own] = np.where(alone & ~near, cosine.argmax(axis=1), -1)
    return out


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closest approach within 20 minutes of each scene, where it isn't at the bracket's end.

    The nearest step comes from a track that scenes of a block of time share, and where that can't tell from propagating
    the whole span; its refinement is propagated. Scenes of a satellite are propagated together.
    """
    span = np.arange(-SPAN_US, SPAN_US + 1, STEP_US)
    for batch in batches:
        lines = list(zip(*[batch.column(c).to_pylist() for c in ("line1", "line2")], strict=True))
        t, *xyz = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t_us", "sx", "sy", "sz"))
        sites = np.stack(xyz, axis=1)
        pairs = sorted(set(lines))
        number = {pair: k for k, pair in enumerate(pairs)}
        of = np.array([number[x] for x in lines], np.int64)
        keep, when, angle = [], [], []
        for k, pair in enumerate(pairs):
            path, every = orbit(*pair), np.flatnonzero(of == k)
            at = _nearest_steps(pair, t[every], sites[every])
            left = np.flatnonzero(at < 0)
            for own in np.array_split(left, -(-len(left) // TOGETHER)) if len(left) else ():
                us = t[every[own]][:, None] + span
                err, pos, _ = path.at(us.ravel())
                at[own] = off_nadir(pos, gmst(us.ravel()), err, np.repeat(sites[every[own]], len(span), axis=0)).reshape(us.shape).argmin(axis=1)
            inside = np.flatnonzero((at > 0) & (at < len(span) - 1))
            for own in np.array_split(inside, -(-len(inside) // REFINED)) if len(inside) else ():
                row, step = every[own], at[own]
                best = closest(*pair, sites[row], t[row] + span[step - 1], t[row] + span[step + 1], STEPS, False)
                err, pos, _ = path.at(best)
                keep.append(row), when.append(best), angle.append(off_nadir(pos, gmst(best), err, sites[row]))
        row, best, off = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((keep, np.int64), (when, np.int64), (angle, np.float64)))
        kept = batch.select(["platform", "t_us", "tle_age_days"]).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(best), pa.array(off)], names=["platform", "t_us", "tle_age_days", "predicted_us", "off_nadir_deg"])


def fresh(rows: DataFrame, max_age_days: float = MAX_AGE_DAYS) -> DataFrame:
    """Rows of (t_us, line1) with ``tle_age_days``, the time between the two to either side, where that is at most so long."""
    return rows.withColumn("tle_age_days", F.abs(F.col("t_us") - epoch_us(F.col("line1"))) / sky.DAY_US).where(F.col("tle_age_days") <= max_age_days)


def matched(scenes: DataFrame, elements: DataFrame, max_age_days: float = MAX_AGE_DAYS) -> DataFrame:
    """Scenes with a centre, a known platform and a fresh element set of its satellite, with that set."""
    known = scenes.sparkSession.createDataFrame(list(PLATFORMS.items()), "platform string, satellite string")
    rows = scenes.where("lat is not null").join(F.broadcast(known), "platform").join(elements.select("satellite", "line1", "line2"), "satellite")
    return fresh(rows, max_age_days)


def scene_matches(scenes: DataFrame, elements: DataFrame, max_age_days: float = MAX_AGE_DAYS) -> DataFrame:
    """(platform, t_us, tle_age_days, predicted_us, off_nadir_deg, dt_s) of scenes with a known platform and a fresh element set."""
    rows = matched(scenes, elements, max_age_days)
    site = rows.withColumn("s", geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.lit(0.0)))
    site = site.select("platform", "t_us", "tle_age_days", "line1", "line2", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"), F.col("s.z").alias("sz"))
    # Dealt by satellite and block of time, so that a platform with many scenes is many tasks' work and a block's track is computed once.
    block = F.floor(F.col("t_us") / TRACK_US)
    dealt = site.repartition(4 * int(scenes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "line1", block).sortWithinPartitions("line1", block)
    found = dealt.mapInArrow(_nearest, "platform string, t_us long, tle_age_days double, predicted_us long, off_nadir_deg double")
    return found.withColumn("dt_s", (F.col("predicted_us") - F.col("t_us")) / 1e6)


def timing(scenes: DataFrame, elements: DataFrame, max_age_days: float = MAX_AGE_DAYS) -> DataFrame:
    """Timing residuals by platform; matches are stored, as the medians read them several times."""
    return skill.residuals(stored(scene_matches(scenes, elements, max_age_days), "matches"))


def loaded(spark: SparkSession, scene_files: str, element_file: str, page_a_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scenes of stored catalogue pages, a file or a line each, and the element sets of the satellites with platforms from a stored file; ValueError where one has no set."""
    sets = parse_3le(spark.read.text(element_file, wholetext=True).select(F.lit("file").alias("source"), "value"))
    roster = catalog.roster_df(spark).join(spark.createDataFrame([(s,) for s in PLATFORMS.values()], "satellite string"), "satellite")  # the few satellites with platforms
    found, missing = for_roster(sets, roster)
    if gone := [r["satellite"] for r in missing.orderBy("satellite").collect()]:
        raise ValueError(f"no element set for {', '.join(gone)}")
    pages = spark.read.text(scene_files, wholetext=not page_a_line).select(F.lit("all").alias("aoi_id"), F.col("value").alias("json"))
    return weather.scenes(pages, need_cloud=False), found


def report(spark: SparkSession, scene_files: str, element_file: str, max_age_days: float = MAX_AGE_DAYS) -> DataFrame:
    """Timing residuals by platform of stored catalogue pages against a stored file of element sets; ValueError where a satellite has no set."""
    scenes, sets = loaded(spark, scene_files, element_file)
    return timing(scenes, sets, max_age_days)


def _drift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position error of the older set at the newer one's epoch, and its share along the track in seconds."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            try:
                old, new = orbit(r["old1"], r["old2"]), orbit(r["line1"], r["line2"])
            except (ValueError, IndexError, ArithmeticError):
                continue  # a malformed set tells nothing and stops nothing
            (e1, p1, _), (e2, p2, v2) = old.at(np.array([new.epoch_us])), new.at(np.array([new.epoch_us]))
            if e1[0] or e2[0]:
                continue
            miss = p1[0] - p2[0]
            along = float(miss @ v2[0] / np.linalg.norm(v2[0]))
            a = lambda o: (geo.MU / (o.kozai / 60) ** 2) ** (1 / 3)
            out.append({"satellite": r["satellite"], "gap_days": r["gap_days"], "da_km": float(a(new) - a(old)), "pos_err_km": float(np.linalg.norm(miss)), "along_track_s": abs(along) / SPEED_KM_S})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("satellite", pa.string()), *[(c, pa.float64()) for c in ("gap_days", "da_km", "pos_err_km", "along_track_s")]]))


def orbit_changes(history: DataFrame) -> DataFrame:
    """From each element set of (satellite, line1, line2) to the next: gap, rise of the semi-major axis, position error, and whether that is thrust."""
    sets = history.withColumn("epoch_us", epoch_us(F.col("line1")))
    both = lagged(sets, ["satellite"], "epoch_us", ["epoch_us", "line1", "line2"], ["line1", "line2", "epoch_us"], BLOCK_US, "old")
    both = both.withColumns({"old1": F.col("old.line1"), "old2": F.col("old.line2"), "gap_days": (F.col("epoch_us") - F.col("old.epoch_us")) / sky.DAY_US})
    moved = both.where("gap_days > 0").select("satellite", "line1", "line2", "old1", "old2", "gap_days").mapInArrow(_drift, "satellite string, gap_days double, da_km double, pos_err_km double, along_track_s double")
    return moved.withColumn("manoeuvred", F.col("da_km") / F.col("gap_days") > MANOEUVRE_KM_PER_DAY)


def manoeuvre_warnings(changes: DataFrame) -> DataFrame:
    text = F.format_string("MANOEUVRE of %s between its last two element sets: its orbit grew by %.0f m in %.2f days, and the older set would place it %.1f km (%.2f s of flight) off.", "satellite", F.col("da_km") * 1000, "gap_days", "pos_err_km", "along_track_s")
    return changes.where("manoeuvred").select("satellite", text.alias("text"))
