"""Imaging views of the star-schema tables, by integer arithmetic on keys; each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.sky import to_us
from skyloom.session import table


def micro(x: Column) -> Column:
    """A double in fixed point, so that two engines agree on it."""
    return F.floor(x * 1e6 + 0.5).cast("long")


def sql_micro(x: str) -> str:
    return f"CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"


def site(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("site"), ((k * 7919 % 1201) / 10 - 60).alias("lat"), ((k * 104729 % 3600) / 10 - 180).alias("lon"), ((k * 31 % 900) / 1000).alias("alt_km"))


SITE = "site AS (SELECT s_suppkey AS site, (s_suppkey * 7919 % 1201) / 10.0 - 60 AS lat, (s_suppkey * 104729 % 3600) / 10.0 - 180 AS lon, (s_suppkey * 31 % 900) / 1000.0 AS alt_km FROM supplier)"


def obs(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", F.concat(F.lit("SAT"), F.col("user_id") % 10).alias("satellite"), (F.col("user_id") % 7).cast("int").alias("run_id"), to_us(F.col("ts")).alias("tca_us"),
        ((e * 7919 % 701) / 10 - 35).alias("off_nadir_deg"), ((e * 104729 % 1301) / 10 - 40).alias("sun_elev_deg"), F.least(F.col("value"), F.lit(100.0)).alias("pct"), "event_type", "user_id",
    )


OBS = "obs AS (SELECT event_id, 'SAT' || (user_id % 10) AS satellite, CAST(user_id % 7 AS INTEGER) AS run_id, epoch_us(ts) AS tca_us, (event_id * 7919 % 701) / 10.0 - 35 AS off_nadir_deg, (event_id * 104729 % 1301) / 10.0 - 40 AS sun_elev_deg, least(value, 100.0) AS pct, event_type, user_id FROM events)"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    hour = F.floor(to_us(F.col("ts")) / 3_600_000_000)
    cut = F.floor(F.least(F.col("value"), F.lit(100.0)) * 1000)
    grouped = table(spark, d, "events").groupBy(hour.alias("idx")).agg((F.sum(cut) / F.count(F.lit(1)) / 1000).alias("total"))
    return grouped.select("idx", (F.col("idx") * 3_600_000_000).alias("t_us"), "total")


HOURLY = "hourly AS (SELECT idx, idx * 3600000000 AS t_us, total FROM (SELECT epoch_us(ts) // 3600000000 AS idx, sum(floor(least(value, 100.0) * 1000)) / count(*) / 1000 AS total FROM events GROUP BY 1))"


def hindcast(spark: SparkSession, d: str) -> DataFrame:
    """The hourly series again for leads of 0 to 7 days: that long before."""
    leads = hourly(spark, d).withColumn("lead_days", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return leads.select("lead_days", "idx", (F.col("t_us") + F.col("lead_days") * 86_400_000_000).alias("t_us"), F.col("total").alias("forecast"))


HINDCAST = "hindcast AS (SELECT CAST(lead_days AS INTEGER) AS lead_days, idx, t_us + lead_days * 86400000000 AS t_us, total AS forecast FROM hourly, range(0, 8) AS r(lead_days))"


def scene(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("landsat-8", "landsat-9", "sentinel-2a", "sentinel-2b", "sentinel-2c", "other")])
    return obs(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("scene"), F.get(names, (F.col("user_id") % 6).cast("int")).alias("platform"), F.col("tca_us").alias("t_us"), F.col("pct").alias("observed")).where("observed is not null")


SCENE = "scene AS (SELECT event_id AS scene, ['landsat-8','landsat-9','sentinel-2a','sentinel-2b','sentinel-2c','other'][1 + CAST(user_id % 6 AS INTEGER)] AS platform, tca_us AS t_us, pct AS observed FROM obs WHERE event_type = 'purchase' AND pct IS NOT NULL)"


def passes(spark: SparkSession, d: str) -> DataFrame:
    from skyloom.functions.grading import access_tier, bucket, quality_badge

    off, sun = F.abs("off_nadir_deg"), F.col("sun_elev_deg")
    graded = obs(spark, d).withColumns({"category": access_tier(off, sun, F.lit(20.0), F.lit(20.0), F.lit(30.0), F.lit(15.0)), "operational": F.col("satellite") != "SAT9", "quality": quality_badge(off, sun)})
    return graded.withColumn("bucket", bucket(F.col("category"), F.col("operational"))).where("bucket is not null")


PASSES = """passes AS (SELECT *, CASE WHEN NOT operational THEN 'nonoperational' WHEN category = 'standard' THEN 'passes' ELSE 'marginal' END AS bucket FROM (
  SELECT *, CASE WHEN abs(off_nadir_deg) <= 20 AND sun_elev_deg >= 20 THEN 'standard' WHEN abs(off_nadir_deg) <= 30 AND sun_elev_deg >= 15 THEN 'marginal' END AS category, satellite <> 'SAT9' AS operational,
    CASE WHEN sun_elev_deg < 15 THEN 'poor' WHEN abs(off_nadir_deg) <= 12 AND sun_elev_deg >= 20 THEN 'good' WHEN abs(off_nadir_deg) <= 20 AND sun_elev_deg >= 15 THEN 'marginal' ELSE 'poor' END AS quality FROM obs) WHERE category IS NOT NULL)"""


def ring(spark: SparkSession, d: str) -> DataFrame:
    """A square or L-shaped ring around each site; some cross the antimeridian, some have no area."""
    h = F.when(F.col("site") % 9 == 0, F.lit(0.0)).otherwise((F.col("site") % 5 + 1) / 20)
    corner = lambda x, y: F.struct((F.col("lon") + x * h).alias("lon"), (F.col("lat") + y * h).alias("lat"))
    square = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
    ell = F.array(corner(-1, -1), corner(2, -1), corner(2, 0), corner(0, 0), corner(0, 2), corner(-1, 2))
    return site(spark, d).withColumn("ring", F.when(F.col("site") % 2 == 0, square).otherwise(ell))


RING = """ring AS (SELECT *, CASE WHEN site % 2 = 0 THEN [{'lon': lon - h, 'lat': lat - h}, {'lon': lon + h, 'lat': lat - h}, {'lon': lon + h, 'lat': lat + h}, {'lon': lon - h, 'lat': lat + h}]
  ELSE [{'lon': lon - h, 'lat': lat - h}, {'lon': lon + 2 * h, 'lat': lat - h}, {'lon': lon + 2 * h, 'lat': lat}, {'lon': lon, 'lat': lat}, {'lon': lon, 'lat': lat + 2 * h}, {'lon': lon - h, 'lat': lat + 2 * h}] END AS ring
  FROM (SELECT *, CASE WHEN site % 9 = 0 THEN 0.0 ELSE (site % 5 + 1) / 20.0 END AS h FROM site))"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    """An analytic off-nadir series of 400 steps a site."""
    return site(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(399)))).select("site", "k", eta_at(F.col("k").cast("double"), F.col("site")).alias("eta"))


def eta_at(t: Column, site_: Column) -> Column:
    return 40 + 38 * F.sin(t / (8 + site_ % 7) + site_)


ETA = "40 + 38 * sin({t} / (8 + site % 7) + site)"
GRID = f"grid AS (SELECT site, k, {ETA.format(t='CAST(k AS DOUBLE)')} AS eta FROM site, range(0, 400) AS r(k))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
