"""Hourly weather series and scene catalogues from their JSON, as long tables.

Network access is a callable the caller passes in (``get(url) -> str``); the readers themselves take a table with
columns aoi_id and json, so stored captures work as well.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import skill

SERIES = "struct<hourly:struct<time:array<string>,cloud_cover:array<double>,cloud_cover_low:array<double>,cloud_cover_mid:array<double>,cloud_cover_high:array<double>>>"
LAYERS = ("low", "mid", "high")


def captures(spark: SparkSession, folder: str) -> DataFrame | None:
    """(name, json) of the JSON files of a folder, each named by its area; None where there is no such folder."""
    try:
        files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    except AnalysisException:
        return None
    return files.select(F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_name", r"\+", "%2B")), r"\.json$", "").alias("name"), F.col("value").alias("json"))


def _times(times: Column) -> Column:
    """Microseconds of naive ISO times, taken as UTC; needs a UTC session."""
    return F.transform(times, lambda t: F.unix_micros(F.try_to_timestamp(t)))


def forecast(files: DataFrame) -> DataFrame:
    """(aoi_id, idx, t_us, total, low, mid, high): a row an hour; series that are missing or short give null."""
    h = files.select("aoi_id", F.from_json("json", SERIES)["hourly"].alias("h"))
    rows = h.select("aoi_id", "h", F.posexplode(_times(F.col("h.time"))).alias("idx", "t_us"))
    layer = lambda k: F.get(F.col(f"h.cloud_cover_{k}"), F.col("idx")).alias(k)
    return rows.select("aoi_id", "idx", "t_us", F.get("h.cloud_cover", F.col("idx")).alias("total"), *[layer(k) for k in LAYERS])


def _by_key(files: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """(aoi_id, idx, t_us, key, pct) of the wanted hourly series, whatever their number."""
    times = F.from_json("json", "struct<hourly:struct<time:array<string>>>")["hourly"]["time"]
    raw = F.from_json(F.get_json_object("json", "$.hourly"), "map<string,string>")
    series = files.select("aoi_id", _times(times).alias("t"), F.explode(F.map_filter(raw, lambda k, v: wanted(k))).alias("key", "v"))
    rows = series.select("aoi_id", "key", F.from_json("v", "array<double>").alias("v"), F.posexplode("t").alias("idx", "t_us"))
    return rows.select("aoi_id", "idx", "t_us", "key", F.get("v", F.col("idx")).alias("pct"))


def ensemble(files: DataFrame) -> DataFrame:
    """(aoi_id, idx, t_us, member, pct): the control and every member."""
    found = _by_key(files, lambda k: (k == "cloud_cover") | k.startswith("cloud_cover_member"))
    return found.withColumnRenamed("key", "member")


def hindcast(files: DataFrame) -> DataFrame:
    """(aoi_id, idx, t_us, lead_days, forecast): what was forecast so many days before."""
    found = _by_key(files, lambda k: k.startswith("cloud_cover_previous_day"))
    return found.select("aoi_id", "idx", "t_us", F.regexp_extract("key", r"([0-9]+)$", 1).cast("int").alias("lead_days"), F.col("pct").alias("forecast"))


FEATURES = "struct<features:array<struct<collection:string,properties:struct<datetime:string,platform:string,`eo:cloud_cover`:double,`proj:centroid`:struct<lat:double,lon:double>,`view:sun_elevation`:double,`view:sun_azimuth`:double>>>>"


def scenes(files: DataFrame, need_cloud: bool = True) -> DataFrame:
    """Scenes of (aoi_id, json) catalogue pages; those without a time (or, if needed, cloud cover) are dropped."""
    f = files.select("aoi_id", F.explode(F.from_json("json", FEATURES)["features"]).alias("f"))
    p = lambda k: F.col(f"f.properties.`{k}`")
    rows = f.select("aoi_id", p("platform").alias("platform"), F.col("f.collection").alias("collection"), F.unix_micros(F.try_to_timestamp(p("datetime"))).alias("t_us"), p("eo:cloud_cover").alias("observed"), F.col("f.properties.`proj:centroid`.lat").alias("lat"), F.col("f.properties.`proj:centroid`.lon").alias("lon"), p("view:sun_elevation").alias("sun_elevation"), p("view:sun_azimuth").alias("sun_azimuth"))
    kept = rows.where("t_us is not null")
    return kept.where("observed is not null") if need_cloud else kept


def climatology(files: DataFrame) -> DataFrame:
    """(name, month, clear_pct) of climatology JSON; keys that begin with _ are notes."""
    rows = files.select(F.explode(F.from_json("json", "map<string,string>")).alias("name", "v")).where(~F.col("name").startswith("_"))
    return rows.select("name", F.explode(F.from_json("v", "map<string,double>")).alias("month", "clear_pct"))


def climatology_json(rates: DataFrame, counts: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """The sink for the above, which reads it back: a JSON object a site, its name as key over those of its months.

    ``counts`` (name, month, n) and the threshold go with it as notes; a site whose months all have too few samples has an empty object.
    """
    month = F.date_format(F.make_date(F.lit(2000), F.col("month"), F.lit(1)), "MMM")
    by_site = lambda t, value: t.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(month, value)))).alias("m"))
    out = by_site(rates, F.round("clear_pct", 1)).withColumnRenamed("m", "months")
    object_ = lambda c: F.to_json(F.create_map("name", c))
    if counts is None:
        return out.select("name", object_("months").alias("json"))
    both = by_site(counts, F.col("n")).join(out, "name", "left").withColumn("months", F.coalesce("months", F.create_map().cast("map<string,double>")))
    notes = F.format_string(',"_threshold_pct":%s,"_sample_counts":%s}', F.lit(threshold).cast("string"), object_("m"))
    return both.select("name", F.concat(F.regexp_replace(object_("months"), r"\}$", ""), notes).alias("json"))


def archive(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """(name, month, cloud_pct) of catalogue pages kept as ``name=.../year=.../*.json``; only folders of the years asked for are read."""
    files = spark.read.text(folder, wholetext=True).where(F.col("year").between(first, last))
    pages = files.select(F.col("name").cast("string").alias("aoi_id"), F.col("value").alias("json"))
    return scenes(pages).select(F.col("aoi_id").alias("name"), F.month(F.timestamp_micros("t_us")).alias("month"), F.col("observed").alias("cloud_pct"))


def climatology_build(observations: DataFrame, threshold: float, least: int) -> DataFrame:
    """(name, json) of (name, month, cloud_pct): the rates of months with enough observations, and the counts of all twelve."""
    rates = skill.monthly_clear_rate(observations, ["name"], threshold, least)
    return climatology_json(rates, skill.monthly_counts(observations, ["name"]), threshold)


def search_body(lat: float, lon: float, start: str, end: str, collections: list[str], limit: int = 100) -> str:
    """A catalogue search for scenes over a place, as JSON; a page has at most 200 of them."""
    if not 1 <= limit <= 200:
        raise ValueError("a page has 1 to 200 scenes")
    return json.dumps({"collections": collections, "intersects": {"type": "Point", "coordinates": [lon, lat]}, "datetime": f"{start}/{end}", "limit": limit})


def fetched(spark: SparkSession, urls: list[tuple[str, str]], get: Callable[[str], str]) -> DataFrame:
    """(aoi_id, json) for a report's few (aoi_id, url); a failing fetch gives no row, so that clouds never stop a prediction."""
    rows = []
    for aoi_id, url in urls:
        try:
            rows.append((aoi_id, get(url)))
        except OSError:
            continue
    return spark.createDataFrame(rows, "aoi_id string, json string")


def hindcast_url(lat: float, lon: float, start: str, end: str, leads: list[int], base: str) -> str:
    """Query for forecasts of earlier days; leads are 1 to 7."""
    if not leads or any(not 1 <= n <= 7 for n in leads):
        raise ValueError("leads must be within 1 to 7 days")
    fields = ",".join(["cloud_cover", *[f"cloud_cover_previous_day{n}" for n in leads]])
    return f"{base}?latitude={lat}&longitude={lon}&hourly={fields}&start_date={start}&end_date={end}&timezone=UTC"
