"""Sensor profiles and satellite rosters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _fov(swath_km: float, alt_km: float) -> float:
    half = swath_km / 2 / 6371.0
    return round(math.degrees(math.atan2(6371.0 * math.sin(half), 6371.0 * (1 - math.cos(half)) + alt_km)), 2)


@dataclass(frozen=True)
class Profile:
    key: str
    display: str
    max_off: float
    marginal_off: float
    min_sun: float
    marginal_sun: float
    swath_km: float
    gsd_m: float
    agile: bool
    satellites: tuple[tuple[str, int, bool], ...]


#: Envelopes, swaths, ground sample distances and catalogue numbers of the supported sensors.
PROFILES = {
    p.key: p
    for p in (
        Profile("dragonette", "Dragonette", 20.0, 30.0, 20.0, 15.0, 20.0, 5.3, True, (("DRAG01", 56225, True), ("DRAG02", 56995, True), ("DRAG03", 58848, True), ("DRAG04", 63254, True), ("DRAG05", 66694, False))),
        Profile("landsat", "Landsat 8/9", _fov(185, 705), _fov(185, 705), 0.0, 0.0, 185.0, 30.0, False, (("LANDSAT8", 39084, True), ("LANDSAT9", 49260, True))),
        Profile("sentinel2", "Sentinel-2", 10.3, 10.3, 0.0, 0.0, 290.0, 10.0, False, (("SENTINEL2A", 40697, True), ("SENTINEL2B", 42063, True), ("SENTINEL2C", 60989, True))),
    )
}
PLATFORMS = {"landsat-8": "LANDSAT8", "landsat-9": "LANDSAT9", "sentinel-2a": "SENTINEL2A", "sentinel-2b": "SENTINEL2B", "sentinel-2c": "SENTINEL2C"}


def profile(key: str | None) -> Profile:
    """A profile by key; null is the first, an unknown key an error."""
    if key is None:
        return next(iter(PROFILES.values()))
    found = PROFILES.get(key.strip().lower())
    if not found:
        raise ValueError(f"unknown sensor {key!r}; known: {', '.join(PROFILES)}")
    return found


def profiles_df(spark: SparkSession) -> DataFrame:
    rows = [(p.key, p.display, p.max_off, p.marginal_off, p.min_sun, p.marginal_sun, p.swath_km, p.gsd_m, p.agile) for p in PROFILES.values()]
    return spark.createDataFrame(rows, "sensor string, display string, max_off double, marginal_off double, min_sun double, marginal_sun double, swath_km double, gsd_m double, agile boolean")


def roster_df(spark: SparkSession, sensors: list[str] | None = None) -> DataFrame:
    rows = [(p.key, i, *s) for p in PROFILES.values() if sensors is None or p.key in sensors for i, s in enumerate(p.satellites)]
    return spark.createDataFrame(rows, "sensor string, ordinal int, satellite string, norad int, operational boolean")
