"""Validation: forecast skill by lead, clear-sky rates by month, timing residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.grading import soft_clear
from skyloom.operators.asof import nearest_join
from skyloom.operators.ordered import medians, same

THRESHOLD = 30.0
LEAST_SAMPLES = 20
SNAP_US = 5_400_000_000


def score(pairs: DataFrame, threshold: float = THRESHOLD, by: list[str] | None = None) -> DataFrame:
    """Skill by lead of (lead_days, observed, forecast), and by ``by``."""
    error, clear = F.col("forecast") - F.col("observed"), (F.col("observed") < threshold).cast("double")
    p = soft_clear(F.col("forecast"), threshold)
    out = pairs.groupBy(*(by or []), "lead_days").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error).alias("bias"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(clear).alias("observed_clear_rate"),
        F.avg(((p >= 0.5) == (clear == 1)).cast("double")).alias("decision_accuracy"),
        F.avg((p - clear) * (p - clear)).alias("brier"),
        (F.avg(clear) * (1 - F.avg(clear))).alias("brier_climatology"),
    )
    return out.withColumn("brier_skill_score", F.when(F.col("brier_climatology") > 0, 1 - F.try_divide("brier", "brier_climatology")))


def pairs(scenes: DataFrame, hindcast: DataFrame) -> DataFrame:
    """Scenes of (aoi_id, scene, platform, t_us, observed), each with the forecast of every lead of its area nearest in time; those without one go."""
    leads = hindcast.select("aoi_id", "lead_days").distinct()
    asked = scenes.join(leads, "aoi_id").withColumnRenamed("t_us", "s_us")
    found = nearest_join(asked, hindcast, ["aoi_id", "lead_days"], "s_us", "t_us", SNAP_US)
    return found.select("aoi_id", "scene", "platform", "lead_days", "observed", F.col("s.forecast").alias("forecast")).where("forecast is not null")


def harness(scenes: DataFrame, hindcast: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forecasts against what was seen, area by area: totals, scenes a platform, and skill by lead."""
    matched = pairs(scenes, hindcast)
    seen = scenes.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("scenes"), F.round(F.avg("observed"), 2).alias("observed_cloud_mean"))
    paired = matched.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("pairings"))
    totals = seen.join(paired, "aoi_id", "left").withColumn("pairings", F.coalesce("pairings", F.lit(0)))
    return totals, scenes.groupBy("aoi_id", "platform").agg(F.count(F.lit(1)).alias("scenes")), score(matched, threshold, ["aoi_id"])


def monthly_clear_rate(observations: DataFrame, by: list[str], threshold: float = THRESHOLD, least: int = LEAST_SAMPLES) -> DataFrame:
    """Percent of clear observations of (by, month, cloud_pct), months with enough of them only."""
    out = observations.where("cloud_pct is not null").groupBy(*by, "month").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cloud_pct") < threshold).alias("clear"))
    return out.where(F.col("n") >= least).withColumn("clear_pct", 100.0 * F.col("clear") / F.col("n"))


def monthly_counts(observations: DataFrame, by: list[str]) -> DataFrame:
    """Counts for all twelve months of every key, 0 where there is none."""
    spine = observations.select(*by).distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    counts = observations.where("cloud_pct is not null").groupBy(*by, "month").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, [*by, "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def residuals(matches: DataFrame) -> DataFrame:
    """Timing residuals by platform, and overall (platform null)."""
    figures = matches.groupingSets([[F.col("platform")], []], F.col("platform")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("dt_s").alias("mean_dt_s"),
        F.stddev_pop("dt_s").alias("stdev_dt_s"),
        F.max(F.abs("dt_s")).alias("max_abs_dt_s"),
        F.avg("off_nadir_deg").alias("mean_off_nadir_deg"),
        F.max("off_nadir_deg").alias("max_off_nadir_deg"),
        F.max("tle_age_days").alias("max_tle_age_days"),
        F.grouping("platform").alias("__all"),
    )
    each = F.explode(F.array(F.struct(F.lit(0).cast("byte").alias("__all"), "platform"), F.struct(F.lit(1).cast("byte").alias("__all"), F.lit(None).cast("string").alias("platform"))))
    middle = medians(matches.select("dt_s", each.alias("__k")).select("dt_s", "__k.*"), ["__all", "platform"], "dt_s", "median_dt_s")
    out = same(figures, middle, ["__all", "platform"], "left")
    return out.select("platform", "n", "mean_dt_s", "median_dt_s", "stdev_dt_s", "max_abs_dt_s", "mean_off_nadir_deg", "max_off_nadir_deg", "max_tle_age_days")
