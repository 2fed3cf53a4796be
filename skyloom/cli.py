"""Command line: passes of satellites over the polygons of KMZ or KML files, as a workbook and JSON."""

from __future__ import annotations

import argparse
import os
import sys
import time
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import functions as F

from skyloom import catalog
from skyloom.functions import sky
from skyloom.operators import campaign, clouds, passes
from skyloom.operators.skill import THRESHOLD
from skyloom.session import session, ship
from skyloom.sources import books, contract, elements, history, kml, report, weather, workbook


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skyloom", description=__doc__)
    p.add_argument("kmz", nargs="+")
    p.add_argument("--days", type=float, default=14.0)
    p.add_argument("--start")
    p.add_argument("--alt", type=float, default=0.0, help="terrain altitude, m")
    p.add_argument("--tz", default="Australia/Brisbane")
    p.add_argument("--max-off-nadir", type=float)
    p.add_argument("--min-sun", type=float)
    p.add_argument("--sensor", default="dragonette", help=f"{', '.join(catalog.PROFILES)} or all")
    p.add_argument("--polygon")
    p.add_argument("--all-polygons", action="store_true")
    p.add_argument("--include-nonoperational", action=argparse.BooleanOptionalAction, default=True)
    sets = p.add_mutually_exclusive_group(required=True)
    sets.add_argument("--tle-file")
    sets.add_argument("--tle-history", metavar="FOLDER", help="Parquet history of element sets")
    p.add_argument("--cloud", action="store_true", help="tell how cloudy passes will be")
    p.add_argument("--cloud-threshold", type=float, default=THRESHOLD, help="percent of cloud that counts as clear")
    p.add_argument("--cloud-files", metavar="FOLDER", help="forecast/NAME.json, ensemble/NAME.json by the area's name, and climatology.json")
    p.add_argument("--nadir-ellipsoid", action="store_true")
    p.add_argument("--json", dest="json_path")
    p.add_argument("-o", dest="out", default="passes.xlsx")
    return p


def outlook(spark, found, aois, start: int, folder: str | None, threshold: float):
    """Passes with their outlook, cloud by day, and what there is to say; series are read only for tiers that are needed, and one that is missing stops nothing."""
    said, wanted = [], clouds.tiers(found, start)
    series = {}
    for tier, kind, read, none in ((1, "forecast", weather.forecast, "aoi_id string, idx int, t_us long, total double, low double, mid double, high double"), (2, "ensemble", weather.ensemble, "aoi_id string, idx int, t_us long, member string, pct double")):
        files = weather.captures(spark, f"{folder}/{kind}") if folder and tier in wanted else None
        if files is not None:
            series[tier] = read(files.join(aois.select("aoi_id", "name"), "name").select("aoi_id", "json"))
        else:
            series[tier] = spark.createDataFrame([], none)
            if tier in wanted:
                said.append(f"There is no cloud {kind} for tier {tier}; its cells show n/a.")
    usual = weather.captures(spark, f"{folder}/climatology.json") if folder else None
    usual = weather.climatology(usual) if usual is not None else spark.createDataFrame([], "name string, month string, clear_pct double")
    out = clouds.with_clouds(found, series[1], series[2], usual, start, threshold).cache()
    if 1 in wanted or 2 in wanted:
        beyond = clouds.beyond_horizon(out).agg(F.sum("n")).first()[0]
        if beyond and not said:
            said.append(f"{beyond} passes lie beyond what the stored cloud series cover; their cells show n/a.")
    return out, clouds.daily(series[1], start).withColumnRenamed("aoi_id", "run_id"), said


def method(a, chosen, places, start: int, said: list[str]) -> list[tuple[str, str]]:
    """What the workbook says of how it was made."""
    stamp = lambda us: time.strftime("%Y-%m-%d %H:%M", time.gmtime(us / 1e6))
    limits = [f"{p.display}: off-nadir up to {p.max_off if a.max_off_nadir is None else a.max_off_nadir:g}°, sun from {p.min_sun if a.min_sun is None else a.min_sun:g}°" + ("" if p.agile else " (fixed view; it can't be tasked)") for p in chosen]
    return [
        ("Generated (UTC)", stamp(time.time() * 1e6)), ("Window (UTC)", f"{stamp(start)} to {stamp(start + int(a.days * sky.DAY_US))}"), ("Sensor", ", ".join(p.display for p in chosen)), *[("Area", f"{r['name']}: {r['place']}") for r in places],
        ("Terrain altitude (m)", f"{a.alt:g}"), ("Satellites", ", ".join(f"{s}={n}" for p in chosen for s, n, _ in p.satellites)), ("Access", "; ".join(limits)), ("Swath, sample distance", "; ".join(f"{p.display}: {p.swath_km:g} km, {p.gsd_m:g} m" for p in chosen)),
        ("Propagation", "SGP4, element sets turned to the earth by mean sidereal time"), ("Off-nadir", "angle at the satellite between nadir and the area's centre at closest approach; positive to the right of the track"), ("Sun", "almanac position at closest approach, without refraction"),
        ("Caveat", "Geometry only: tasking, duty cycles and cloud decide what is really taken."), *[("Warning", t) for t in said],
    ]


def main(argv: list[str] | None = None, spark=None) -> int:
    """0: done; 2: bad input; 3: element sets missing."""
    a = arguments().parse_args(argv)
    try:
        chosen = list(catalog.PROFILES.values()) if a.sensor == "all" else [catalog.profile(a.sensor)]
        sky.validate_window(a.days)
        ZoneInfo(a.tz)
        if not 0 <= a.cloud_threshold <= 100:
            raise ValueError(f"--cloud-threshold is {a.cloud_threshold:g}; 0 to 100 are allowed")
    except (ValueError, ZoneInfoNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    spark = spark or session("skyloom")
    ship(spark)
    files = kml.read_kml(spark, a.kmz[0])
    for path in a.kmz[1:]:
        files = files.unionByName(kml.read_kml(spark, path))
    aois = kml.polygons(files, a.alt)
    aois = (aois if a.all_polygons else kml.chosen(aois, a.polygon)).cache()
    if (bad := aois.where("error is not null").first()) or not aois.head(1):
        print(f"error: {bad['name'] + ': ' + bad['error'] if bad else 'no polygon found'}", file=sys.stderr)
        return 2
    now = int(time.time() * 1e6)
    start = spark.range(1).select(sky.start_us(F.lit(a.start).cast("string"), now)).first()[0]
    lines = elements.parse_3le(spark.read.text(a.tle_file, wholetext=True).select(F.lit("file").alias("source"), "value")).drop("source", "ord") if a.tle_file else None
    found, said, roster = [], [], []
    for profile in chosen:
        wanted = catalog.roster_df(spark, [profile.key])
        held = lines
        if held is None:
            try:
                held, notes = history.acquire(spark, wanted, a.tle_history, now)
            except RuntimeError as e:
                print(f"error: {e}", file=sys.stderr)
                return 3
            held, said = held.drop("satellite"), said + notes
        sets, missing = elements.for_roster(held, wanted)
        if gone := [r["satellite"] for r in missing.collect()]:  # a roster's size at most
            print(f"error: no element set for {', '.join(gone)}", file=sys.stderr)
            return 3
        reach = max(profile.max_off if a.max_off_nadir is None else a.max_off_nadir, profile.marginal_off)
        close = passes.candidates(aois, sets, start, a.days, ellipsoid=a.nadir_ellipsoid, reach_deg=min(reach, passes.CUTOFF_DEG)).cache()  # passes and warnings share it
        found.append(passes.predict(aois, sets, profile, start, a.days, found=close, ellipsoid=a.nadir_ellipsoid, include_nonoperational=a.include_nonoperational, max_off=a.max_off_nadir, min_sun=a.min_sun))
        said += [r["text"] for r in passes.warnings(close, sets, start, passes.steps_of(a.days)).orderBy("ord").collect()]
        roster += profile.satellites
    out, daily = campaign.merged(found).cache(), None
    if a.cloud and out.head(1):
        out, daily, more = outlook(spark, out, aois, start, a.cloud_files, a.cloud_threshold)
        said += more
    said = list(dict.fromkeys(said))
    places = aois.select("name", workbook.position(F.col("lat"), F.col("lon")).alias("place")).orderBy("name").collect()
    first = chosen[0]
    hints = {
        "marginal": f"Off-nadir of {first.max_off:.0f} to {first.marginal_off:.0f}°, or sun of {first.marginal_sun:.0f} to {first.min_sun:.0f}°: outside the standard envelope, to be confirmed with the operator.",
        "nonoperational": f"Not in service yet, for planning only and not counted: {', '.join(s for s, _, on in roster if not on)}.",
    }
    stamp = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm")
    whole = F.lit("all").alias("run_id")
    several = len({r["name"] for r in places}) > 1
    labels = list(dict.fromkeys(r["name"] for r in places)) if several else sorted(s for s, _, _ in roster)
    counted = spark.createDataFrame(list(enumerate(labels)), "ord int, label string").select(whole, "ord", "label")
    notes = spark.createDataFrame([(k, *n) for k, n in enumerate(method(a, chosen, places, start, said))], "ord int, item string, value string").select(whole, "ord", "item", "value")
    target = lambda path: path if "://" in path else os.path.abspath(path)
    books.write_books(books.workbook_rows(out.withColumn("run_id", whole), spark.range(1).select(whole), counted, notes, a.tz, hints, several), target(a.out), single=True)
    named = out.withColumn("run_id", F.col("aoi_id"))
    if a.json_path:
        ring = F.transform("ring", lambda v: F.array(F.round(v["lon"], 6), F.round(v["lat"], 6)))
        info = F.struct("name", F.round("lat", 5).alias("centroid_lat"), F.round("lon", 5).alias("centroid_lon"), F.lit(a.alt).alias("terrain_alt_m"), ring.alias("vertices_lonlat"))
        operational = F.create_map(*[F.lit(x) for s, _, on in roster for x in (s, on)])
        sensor = F.struct(F.lit("all" if len(chosen) > 1 else first.key).alias("key"), F.lit(", ".join(p.display for p in chosen)).alias("display"), F.array(*[F.lit(s) for s, _, _ in roster]).alias("satellites"), operational.alias("operational"))
        window = F.array(contract.iso_seconds(F.lit(start)), contract.iso_seconds(F.lit(start + int(a.days * sky.DAY_US))))
        chosen_values = {
            "days": a.days, "terrain_alt_m": a.alt, "max_off_nadir_deg": first.max_off if a.max_off_nadir is None else a.max_off_nadir, "min_sun_elev_deg": first.min_sun if a.min_sun is None else a.min_sun, "marginal_off_nadir_deg": first.marginal_off, "marginal_sun_elev_deg": first.marginal_sun,
            "coarse_step_s": passes.STEP_S, "include_nonoperational": a.include_nonoperational, "nadir_ellipsoid": a.nadir_ellipsoid, "swath_km": first.swath_km, "gsd_nadir_m": first.gsd_m, "sensor": "all" if len(chosen) > 1 else first.key, "sensor_display": ", ".join(p.display for p in chosen), "agile": first.agile,
        }
        params = F.struct(*[F.lit(v).alias(k) for k, v in chosen_values.items()])
        runs = aois.select(F.col("aoi_id").alias("run_id"), info.alias("aoi"), sensor.alias("sensor"), window.alias("window_utc"), params.alias("params"))
        texts = runs.select("run_id", F.posexplode(F.array(*[F.lit(t) for t in said])).alias("ord", "text"))
        documents = contract.predictions_json(runs, named, texts, campaign.summary(named, ["run_id"], ["tca_us"]), a.days, daily)
        report.write_report(documents, target(a.json_path))
    for r in out.groupBy("name", "bucket").count().orderBy("name", "bucket").collect():
        print(f"{r['name']}: {r['count']} {r['bucket']}")
    for r in out.where("bucket <> 'marginal'").orderBy("name", "bucket", "tca_us").select("satellite", "bucket", stamp("tca_us").alias("t"), "off_nadir_deg", "sun_elev_deg", "slant_range_km").collect():
        print(f"  {r['satellite']}  {r['t']}  off-nadir {r['off_nadir_deg']:+.1f}°  sun {r['sun_elev_deg']:.1f}°  slant {r['slant_range_km']:.0f} km" + ("" if r["bucket"] == "passes" else "  (not operational)"))
    for text in said:
        print(f"warning: {text}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
