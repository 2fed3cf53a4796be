"""The versioned JSON contract of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "2.1"
HORIZON_DAYS = 5
#: The keys of a pass; ``cloud`` follows them where there is one.
PASS_FIELDS = (
    "satellite", "tca_utc", "off_nadir_deg", "sun_elev_deg", "max_off_nadir_aoi_deg", "slant_range_km", "tle_epoch_utc", "category", "operational",
    "node", "local_solar_time_h", "quality", "timing_sigma_s", "coverage_pct", "footprint_lonlat", "geometry",
)
#: Decimals of the numbers shown.
DIGITS = {"off_nadir_deg": 1, "sun_elev_deg": 4, "max_off_nadir_aoi_deg": 1, "slant_range_km": 0, "local_solar_time_h": 2, "timing_sigma_s": 2, "coverage_pct": 3}
GEOMETRY_DIGITS = {"view_zenith_deg": 1, "phase_deg": 1, "sun_glint_deg": 1, "effective_gsd_m": 2, "sun_azimuth_deg": 1, "view_azimuth_deg": 1, "airmass_view": 2, "airmass_sun": 2, "ground_track_heading_deg": 1}
_NULLS = {"ignoreNullFields": "false"}


def iso_seconds(us: Column) -> Column:
    """UTC, cut to seconds, with its offset; needs a UTC session."""
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def pass_json(passes: DataFrame) -> Column:
    """A pass as JSON; fields without a value are null, but ``cloud``, if it has none, is left out."""
    made = {"tca_utc": iso_seconds(F.col("tca_us"))}
    if "tle_epoch_us" in passes.columns:
        made["tle_epoch_utc"] = iso_seconds(F.col("tle_epoch_us"))
    facts = F.to_json(F.struct(*[(made[c] if c in made else F.col(c)).alias(c) for c in PASS_FIELDS if c in made or c in passes.columns]), _NULLS)
    if "cloud" not in passes.columns:
        return facts
    return F.when(F.col("cloud").isNull(), facts).otherwise(_members(facts, F.concat(F.lit('"cloud":'), F.to_json("cloud", _NULLS))))


def _members(text: Column, *more: Column) -> Column:
    """A JSON object with members of its own, and more of them."""
    return F.concat(F.regexp_replace(text, r"\}$", ""), *[x for m in more for x in (F.lit(","), m)], F.lit("}"))


def rounded(passes: DataFrame) -> DataFrame:
    """Passes as they are shown: fixed decimals, half away from zero."""
    out = passes.withColumns({c: F.round(c, n) for c, n in DIGITS.items() if c in passes.columns})
    if "geometry" in passes.columns:
        known = passes.schema["geometry"].dataType.names
        for k, n in GEOMETRY_DIGITS.items():
            if k in known:
                out = out.withColumn("geometry", F.col("geometry").withField(k, F.round(f"geometry.{k}", n)))
    return out


def summary_json(summary: DataFrame, days: float) -> Column:
    """A run's summary: counts always, gaps from two good passes on, the best window where there is one."""
    window = F.struct(
        iso_seconds(F.col("start_us")).alias("start_utc"), iso_seconds(F.col("end_us")).alias("end_utc"), F.col("n").alias("good_passes"),
        F.round("mean_off", 1).alias("mean_off_nadir_deg"), F.round("mean_sun", 1).alias("mean_sun_elev_deg"), "satellites",
    )
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    hours = [F.round(c, 1).alias(c) for c in ("median_revisit_h", "max_gap_h")]
    return F.to_json(F.struct(count("total_opportunities"), count("good_quality"), F.lit(float(days)).alias("window_days"), *hours, F.when(F.col("start_us").isNotNull(), window).alias("best_window")))


def predictions_json(runs: DataFrame, passes: DataFrame, warnings: DataFrame, summary: DataFrame, days: float, daily: DataFrame | None = None) -> DataFrame:
    """(run_id, json): a document a run, of its area, window, buckets in time order, cloud by day, warnings, summary and parameters.

    ``runs``: run_id, sensor, aoi, window_utc, params; ``daily``: run_id, day (since 1970), pct. A run's passes are few (one
    area, one window of at most 31 days), so they may be collected by run.
    """
    shown = rounded(passes)
    row = shown.select("run_id", "bucket", F.struct("tca_us", "satellite", pass_json(shown).alias("j")).alias("p"))
    lists = row.groupBy("run_id").pivot("bucket", ["passes", "marginal", "nonoperational"]).agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["j"]))
    said = warnings.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("warnings"))
    full = runs.join(lists, "run_id", "left").join(said, "run_id", "left").join(summary, "run_id", "left")
    if daily is None:
        full = full.withColumn("days", F.lit(None).cast("map<string,double>"))
    else:
        cell = F.struct(F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd"), F.round("pct", 1))
        full = full.join(daily.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("days")), "run_id", "left")
    array = lambda c: F.concat(F.lit("["), F.concat_ws(",", F.coalesce(c, F.array().cast("array<string>"))), F.lit("]"))
    horizon = iso_seconds(F.unix_micros(F.to_timestamp(F.get("window_utc", 0))) + HORIZON_DAYS * 86_400_000_000)
    head = F.to_json(F.struct("sensor", "aoi", "window_utc", F.when(F.col("days").isNotNull(), horizon).alias("cloud_horizon_utc"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), "params"), _NULLS)
    body = [F.concat(F.lit(f'"{b}":'), array(F.col(b))) for b in ("passes", "marginal", "nonoperational")]
    by_day = F.concat(F.lit('"cloud_daily":'), F.coalesce(F.to_json("days"), F.lit("{}")))
    return full.select("run_id", _members(head, *body, by_day, F.concat(F.lit('"summary":'), summary_json(summary, days))).alias("json"))


def root(documents: list[str]) -> str:
    """The contract of one report: the document of a single run, or those of several under ``aois``."""
    version = f'{{"schema_version":"{SCHEMA_VERSION}",'
    return version + (documents[0][1:] if len(documents) == 1 else '"aois":[' + ",".join(documents) + "]}")
