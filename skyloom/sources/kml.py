"""Areas of interest from KMZ and KML files."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skyloom.functions import geo

#: Fixed limits on untrusted files.
MAX_BYTES, MAX_MEMBERS, MAX_INNER, MAX_RATIO, MAX_NAME = 10 << 20, 64, 50 << 20, 200, 120
TAG, BRACKET = re.compile(r"<[^>]*>"), re.compile(r"[<>]")
PLACEMARK = r"(?s)(<Placemark\b.*?</Placemark>)"


def kml_text(data: bytes) -> str:
    """KML of a file: of a zip, its first .kml member, never written to disk."""
    if len(data) > MAX_BYTES:
        raise ValueError(f"file of {len(data)} bytes; at most {MAX_BYTES} are allowed")
    if data[:2] != b"PK":
        return data.decode("utf-8", "replace")
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        names = box.infolist()
        if len(names) > MAX_MEMBERS:
            raise ValueError(f"archive of {len(names)} members")
        member = next((m for m in names if m.filename.lower().endswith(".kml")), None)
        if member is None:
            raise ValueError("archive without a .kml member")
        if member.file_size > MAX_INNER or member.file_size > MAX_RATIO * max(1, member.compress_size):
            raise ValueError("archive member is too large or too highly compressed")
        return box.read(member).decode("utf-8", "replace")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(source, kml) of files; a file beyond the size limit is refused, before any content reaches Python."""
    said = F.format_string(f"%s has %d bytes; at most {MAX_BYTES} are allowed", "path", "length")
    files = spark.read.format("binaryFile").load(path).withColumn("content", F.when(F.col("length") <= MAX_BYTES, F.col("content")).otherwise(F.raise_error(said).cast("binary")))
    unzip = F.pandas_udf(lambda s: s.map(kml_text), T.StringType())
    return files.select(F.col("path").alias("source"), unzip("content").alias("kml"))


def _readable(text: pa.Array) -> pa.Array:
    bare = (None if x is None else BRACKET.sub("", TAG.sub("", html.unescape(x))) for x in text.to_pylist())
    return pa.array([None if x is None else "".join(c for c in x if c.isprintable()) for x in bare], pa.string())


def readable(text: Column) -> Column:
    """Entities resolved, then markup and characters that don't print dropped; null stays null."""
    return F.arrow_udf(_readable, T.StringType())(text)


def bare(text: Column) -> Column:
    """&lt;, &gt; and &amp; resolved, then markup dropped; other entities and characters stay."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.regexp_replace(text, r"<[^>]*>|[<>]", "")


def clean_name(raw: Column, resolved: Callable[[Column], Column] = readable) -> Column:
    """A safe display name: CDATA unwrapped, made ``resolved``, white space collapsed, cut to MAX_NAME."""
    inner = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?s)^<!\[CDATA\[(.*?)\]\]>$", "$1")
    spaced = F.regexp_replace(resolved(inner), r"[ \t\n\f\r]+", " ")
    return F.coalesce(F.nullif(F.substring(F.trim(spaced), 1, MAX_NAME), F.lit("")), F.lit("AOI"))


def polygon_blocks(files: DataFrame) -> DataFrame:
    """(source, ordinal, block): placemarks that hold a polygon, in document order; a file whose polygon has no placemark is one bare polygon."""
    marks = F.filter(F.regexp_extract_all("kml", F.lit(PLACEMARK), 1), lambda b: b.contains("<Polygon"))
    blocks = F.when(F.size(marks) > 0, marks).when(F.col("kml").contains("<Polygon"), F.array("kml")).otherwise(F.array().cast("array<string>"))
    return files.select("source", F.posexplode(blocks).alias("ordinal", "block"))


def raw_name(block: Column) -> Column:
    return F.regexp_extract(block, r"(?s)<name[^>]*>(.*?)</name>", 1)


def ring_of(block: Column) -> Column:
    """Outer ring <lon, lat> without its closing vertex; tokens are lon,lat[,alt]."""
    outer = F.regexp_extract(block, r"(?s)<outerBoundaryIs\b.*?<coordinates[^>]*>(.*?)</coordinates>", 1)
    coords = F.when(outer != "", outer).otherwise(F.regexp_extract(block, r"(?s)<coordinates[^>]*>(.*?)</coordinates>", 1))
    tokens = F.filter(F.split(F.trim(F.regexp_replace(coords, r"\s+", " ")), " "), lambda t: t.contains(","))
    number = lambda t, k: F.get(F.split(t, ","), F.lit(k)).try_cast("double")
    ring = F.transform(tokens, lambda t: F.struct(number(t, 0).alias("lon"), number(t, 1).alias("lat")))
    closed = (F.size(ring) > 1) & (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1)))
    return F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def polygons(files: DataFrame, terrain_alt_m: float = 0.0, name=clean_name) -> DataFrame:
    """Areas of interest of (source, kml): one row a polygon; ``error`` says what is wrong with those that can't be used."""
    rows = polygon_blocks(files).withColumns({"name": name(raw_name(F.col("block"))), "ring": ring_of(F.col("block"))})
    bad = F.when(F.size("ring") < 3, "fewer than 3 vertices").when(F.exists("ring", lambda v: v["lon"].isNull() | v["lat"].isNull()), "a coordinate is not a number")
    rows = rows.withColumn("error", bad).withColumn("centroid", F.when(bad.isNull(), geo.shoelace_centroid(F.col("ring"))))
    aoi = F.concat_ws("#", "source", "ordinal").alias("aoi_id")
    return rows.select(aoi, "source", "ordinal", "name", "ring", F.col("centroid.lon").alias("lon"), F.col("centroid.lat").alias("lat"), F.lit(terrain_alt_m / 1000).alias("alt_km"), "error")


def chosen(aois: DataFrame, polygon_name: str | None = None) -> DataFrame:
    """One polygon a file: the first whose name holds ``polygon_name`` in any case; without a name, ``error`` marks files of several."""
    files = W.partitionBy("source")
    if polygon_name is None:
        several = F.count(F.lit(1)).over(files) > 1
        marked = aois.withColumn("error", F.when(several, "several polygons; name one").otherwise(F.col("error")))
        return marked.withColumn("__r", F.row_number().over(files.orderBy("ordinal"))).where("__r = 1").drop("__r")
    hits = aois.where(F.lower("name").contains(polygon_name.lower()))
    return hits.withColumn("__r", F.row_number().over(files.orderBy("ordinal"))).where("__r = 1").drop("__r")
