"""Access, quality and cloud grades as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIER1_DAYS, TIER2_DAYS = 5, 15
SOFT_PCT = 8.0


def access_tier(off_abs: Column, sun: Column, max_off: Column, min_sun: Column, marginal_off: Column, marginal_sun: Column) -> Column:
    """standard, marginal or null, on unrounded values."""
    return F.when((off_abs <= max_off) & (sun >= min_sun), "standard").when((off_abs <= marginal_off) & (sun >= marginal_sun), "marginal")


def bucket(category: Column, operational: Column) -> Column:
    return F.when(category.isNull(), F.lit(None)).when(~operational, "nonoperational").when(category == "standard", "passes").otherwise("marginal")


def quality_badge(off_abs: Column, sun: Column) -> Column:
    return F.when(sun < 15, "poor").when((off_abs <= 12) & (sun >= 20), "good").when((off_abs <= 20) & (sun >= 15), "marginal").otherwise("poor")


def offnadir_band(off_abs: Column) -> Column:
    return F.when(off_abs <= 5, 0).when(off_abs <= 12, 1).otherwise(2)


def cloud_band(pct: Column) -> Column:
    return F.when(pct.isNull(), "unknown").when(pct < 30, "clear").when(pct < 70, "partly").otherwise("cloudy")


def timing_sigma_s(age_days: Column) -> Column:
    return (1 + 2 * F.greatest(age_days, F.lit(0.0))) / 7.5


def cloud_tier(lead_days: Column) -> Column:
    return F.when(lead_days < TIER1_DAYS, 1).when(lead_days < TIER2_DAYS, 2).otherwise(3)


def obstruction(low: Column, mid: Column, high: Column) -> Column:
    return F.least(F.lit(100.0), low + mid + 0.4 * high)


def likely_cloudy(tier: Column, total: Column, obstructed: Column, p_clear: Column) -> Column:
    return F.coalesce(F.when(tier == 1, F.coalesce(obstructed > 60, total > 70)).when(tier == 2, p_clear < 0.3), F.lit(False))


def total_band(total: Column, lead_days: Column) -> Column:
    """Lower and upper bound of a forecast's total cloud."""
    half = 10 + 3 * F.least(lead_days, F.lit(5.0))
    return F.struct(F.greatest(F.lit(0.0), total - half).alias("low"), F.least(F.lit(100.0), total + half).alias("high"))


def soft_clear(pct: Column, threshold: float) -> Column:
    """Probability that a forecast cloud cover turns out below the threshold."""
    return 1 / (1 + F.exp((pct - threshold) / SOFT_PCT))
