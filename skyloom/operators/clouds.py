"""Cloud outlook of passes: forecast, ensemble or climatology, by how far ahead a pass lies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import grading, sky
from skyloom.operators.asof import nearest_join

TOLERANCE_US = 5_400_000_000
CIRRUS_PCT = 20
#: What an outlook of tier 0 to 3 is called.
LABELS = ("n/a", "forecast", "outlook (probabilistic)", "")


def with_clouds(passes: DataFrame, forecast: DataFrame, ensemble: DataFrame, climatology: DataFrame, ref_us: int, threshold: float = 30.0) -> DataFrame:
    """Passes with struct ``cloud``. Tier 1: nearest forecast hour with an error band; tier 2: share of ensemble members that are likely clear;
    tier 3: no outlook but the climatology of the month of the window's start, which all tiers have. A pass without a sample within
    1.5 h, or without any member's value, is of tier 0.
    """
    lead = (F.col("tca_us") - ref_us) / sky.DAY_US
    month = F.date_format(F.timestamp_micros(F.lit(ref_us)), "MMM")
    usual = climatology.where(F.col("month") == month).select(F.col("name").alias("__name"), F.col("clear_pct").alias("clim"))
    asked = passes.join(usual, F.col("name") == F.col("__name"), "left").drop("__name").withColumns({"lead": lead, "tier": grading.cloud_tier(lead)})
    # Samples of both tiers in one table: each pass looks among those of its own, in one pass over all.
    hours = ensemble.groupBy("aoi_id", "idx", "t_us").agg(F.avg(grading.soft_clear(F.col("pct"), threshold)).alias("p"), F.min("pct").alias("lo"), F.max("pct").alias("hi"))
    samples = forecast.select("aoi_id", F.lit(1).alias("tier"), "idx", "t_us", "total", "low", "mid", "high").unionByName(hours.withColumn("tier", F.lit(2)), allowMissingColumns=True)
    near = nearest_join(asked, samples, ["aoi_id", "tier"], "tca_us", "t_us", TOLERANCE_US)
    s = lambda c: F.col(f"s.{c}")
    found = F.when(F.col("tier") == 3, 3).when((F.col("tier") == 1) & F.col("s").isNotNull(), 1).when((F.col("tier") == 2) & s("p").isNotNull(), 2).otherwise(0)
    band = grading.total_band(s("total"), F.col("lead"))
    cloud = _cloud(
        found, threshold, total=s("total"), low=s("low"), mid=s("mid"), high=s("high"), band=F.when(s("total").isNotNull(), F.array(F.bround(band["low"]), F.bround(band["high"]))),
        obstruction=F.when(found == 1, grading.obstruction(s("low"), s("mid"), s("high"))), p_clear=s("p"), spread=F.when(s("lo").isNotNull(), F.array(s("lo"), s("hi"))),
    )
    return near.withColumn("cloud", cloud).drop("lead", "tier", "clim", "s")


def tiers(passes: DataFrame, ref_us: int) -> set[int]:
    """The tiers the passes need, at most three: a series is only read if one needs it."""
    lead = (F.col("tca_us") - ref_us) / sky.DAY_US
    return {r[0] for r in passes.select(grading.cloud_tier(lead)).distinct().collect()}


def has_cloud(passes: DataFrame) -> bool:
    """Whether any pass has an outlook."""
    return "cloud" in passes.columns and bool(passes.agg(F.bool_or(F.col("cloud").isNotNull())).first()[0])


def _cloud(tier, threshold: float, total=None, low=None, mid=None, high=None, p_clear=None, spread=None, band=None, obstruction=None):
    number = lambda c: (F.lit(None) if c is None else c).cast("double")
    pair = lambda c: (F.lit(None) if c is None else c).cast("array<double>")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), tier + 1)
    fields = {
        "tier": tier, "label": label, "total_pct": number(total), "low_pct": number(low), "mid_pct": number(mid), "high_pct": number(high), "p_clear": F.round(number(p_clear), 3), "threshold_pct": F.lit(float(threshold)),
        "spread_pct": pair(spread), "clim_clear_pct": number(F.col("clim")), "total_band_pct": pair(band), "optical_obstruction_pct": F.round(number(obstruction), 1), "cirrus_flag": F.coalesce(number(high) > CIRRUS_PCT, F.lit(False)),
        "likely_cloudy": grading.likely_cloudy(tier, number(total), number(obstruction), number(p_clear)),
    }
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def beyond_horizon(passes: DataFrame) -> DataFrame:
    """How many passes of each area found no sample."""
    return passes.groupBy("aoi_id").agg(F.count_if(F.col("cloud.tier") == 0).alias("n"))


def daily(forecast: DataFrame, ref_us: int) -> DataFrame:
    """Mean total cloud of each area and UTC day that has any, within five days from the reference time."""
    window = forecast.where(F.col("total").isNotNull() & F.col("t_us").between(ref_us, ref_us + 5 * sky.DAY_US))
    return window.groupBy("aoi_id", F.floor(F.col("t_us") / sky.DAY_US).alias("day")).agg(F.avg("total").alias("pct"))
