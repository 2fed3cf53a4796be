"""Time and the sun as column expressions over microseconds since 1970 (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.geo import gmst_rad
from skyloom.functions.vectors import unit_bound

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MAX_DAYS = 31


def to_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def start_us(text: Column, now_us: int) -> Column:
    """Start of a window: offsets are converted, naive times are UTC, null is now."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)), F.lit(now_us))


def validate_window(days: float) -> float:
    if not 0 < days <= MAX_DAYS:
        raise ValueError(f"window of {days} days; more than 0 and at most {MAX_DAYS} are allowed")
    return days


def julian(us: Column) -> Column:
    """Julian date in two parts: midnight, and the fraction of the day."""
    return F.struct((2440587.5 + F.floor(us / DAY_US)).alias("jd"), (F.pmod(us, F.lit(DAY_US)) / float(DAY_US)).alias("fr"))


def sun_position(us: Column, lat: Column, lon: Column) -> Column:
    """Elevation, azimuth (degrees) and true solar time (hours), low-precision almanac formulas."""
    j = julian(us)
    jd = j["jd"] + j["fr"]
    n = (j["jd"] - 2451545.0) + j["fr"]
    mean = F.radians(F.pmod(280.460 + 0.9856474 * n, F.lit(360.0)))
    anomaly = F.radians(F.pmod(357.528 + 0.9856003 * n, F.lit(360.0)))
    ecliptic = mean + F.radians(1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly))
    tilt = F.radians(23.439 - 4e-7 * n)
    ra = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    dec = F.asin(unit_bound(F.sin(tilt) * F.sin(ecliptic)))
    hour = F.radians(F.pmod(F.degrees(gmst_rad(jd) + F.radians(lon) - ra) + 180.0, F.lit(360.0)) - 180.0)
    phi = F.radians(lat)
    el = F.degrees(F.asin(unit_bound(F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(hour))))
    az = F.pmod(F.degrees(F.atan2(-F.cos(dec) * F.sin(hour), F.sin(dec) * F.cos(phi) - F.cos(dec) * F.sin(phi) * F.cos(hour))), F.lit(360.0))
    tst = F.pmod(F.degrees(hour) / 15.0 + 12.0, F.lit(24.0))
    return F.struct(el.alias("elevation"), az.alias("azimuth"), tst.alias("solar_time"))
