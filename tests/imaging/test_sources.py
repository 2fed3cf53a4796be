"""Readers and sinks on small captures."""

import io
import json
import xml.etree.ElementTree as ET
import zipfile

import pytest

from skyloom import catalog, cli
from skyloom.functions import sky
from skyloom.operators import clouds, passes, skill, validation
from skyloom.sources import elements, history, kml, weather, workbook
from tests.imaging.test_orbits import element_set


def square(name, lat, lon, h=0.045):
    ring = [(lon - h, lat - h), (lon + h, lat - h), (lon + h, lat + h), (lon - h, lat + h), (lon - h, lat - h)]
    return f"<Placemark><name>{name}</name><Polygon><outerBoundaryIs><LinearRing><coordinates>{' '.join(f'{x},{y},0' for x, y in ring)}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"


def kmz(*marks):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        box.writestr("readme.txt", "x")
        box.writestr("Doc.KML", "<kml>" + "".join(marks) + "</kml>")
    return out.getvalue()


def test_kml(spark, tmp_path):
    (tmp_path / "a.kmz").write_bytes(kmz(square("<![CDATA[<img src=x onerror=1>AOI 10]]>", -20, 150), "<Placemark><name>p</name><Point/></Placemark>", square("AOI &amp;lt;1", 10, 20)))
    out = kml.polygons(kml.read_kml(spark, str(tmp_path / "a.kmz"))).orderBy("ordinal").collect()
    assert [r["name"] for r in out] == ["AOI 10", "AOI &lt;1"] and [len(r["ring"]) for r in out] == [4, 4]
    assert abs(out[0]["lat"] + 20) < 1e-9 and abs(out[0]["lon"] - 150) < 1e-9
    aois = kml.polygons(kml.read_kml(spark, str(tmp_path / "a.kmz")))
    assert kml.chosen(aois).first()["error"] and kml.chosen(aois, "aoi 10").first()["error"] is None
    with pytest.raises(ValueError):
        kml.kml_text(b"x" * (kml.MAX_BYTES + 1))
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as box:
        box.writestr("a.kml", b"0" * 10_000_000)
    with pytest.raises(ValueError):
        kml.kml_text(bomb.getvalue())


def test_three_line_sets(spark):
    one, two = element_set(56225, 1, 2)
    newer = element_set(56225, 3, 4)
    text = f"NAME\n{one}\n{two}\nstray\n2 lone\n{newer[0]}\r\n{newer[1]}\n1 only\n"
    sets = elements.parse_3le(spark.createDataFrame([("f", text)], "source string, value string"))
    assert [(r["norad"], r["line2"]) for r in sets.collect()] == [(56225, newer[1])]
    found, missing = elements.for_roster(sets, catalog.roster_df(spark, ["dragonette"]))
    assert found.count() == 1 and missing.count() == 4
    assert sets.select(elements.epoch_us(sets.line1)).first()[0] == 1782777600000000


def test_weather_and_clouds(spark):
    times = [f"2026-07-01T{h:02d}:00" for h in range(4)]
    fc = {"hourly": {"time": times, "cloud_cover": [10, None, 30, 40], "cloud_cover_low": [50, 1, 1, 1], "cloud_cover_mid": [10, 1, 1, 1], "cloud_cover_high": [30, 1, 1]}}
    ens = {"hourly": {"time": ["2026-07-08T00:00"], "cloud_cover": [20], "cloud_cover_member01": [30], "cloud_cover_member02": [90], "other": [1]}}
    table = lambda x: spark.createDataFrame([("a", json.dumps(x))], "aoi_id string, json string")
    f, e = weather.forecast(table(fc)), weather.ensemble(table(ens))
    assert f.count() == 4 and e.count() == 3 and f.where("high is null").count() == 1
    clim = weather.climatology(spark.createDataFrame([(json.dumps({"A": {"Jul": 62.5}, "_note": "x"}),)], "json string"))
    ref = f.agg({"t_us": "min"}).first()[0]
    day = sky.DAY_US
    rows = [("a", "A", "S", ref + 60_000_000, 1), ("a", "A", "S", ref + 3_600_000_000, 2), ("a", "A", "S", ref + 7 * day, 3), ("a", "A", "S", ref + 6 * day, 4), ("a", "A", "S", ref + 20 * day, 5), ("a", "A", "S", ref + day, 6)]
    passes = spark.createDataFrame(rows, "aoi_id string, name string, satellite string, tca_us long, k int")
    out = {r["k"]: r["cloud"] for r in clouds.with_clouds(passes, f, e, clim, ref).collect()}
    assert out[1]["total_pct"] == 10 and out[1]["optical_obstruction_pct"] == 72.0 and out[1]["likely_cloudy"] and out[1]["cirrus_flag"] and out[1]["total_band_pct"] == [0.0, 20.0]
    assert out[2]["tier"] == 1 and out[2]["total_pct"] is None
    assert out[3]["tier"] == 2 and out[3]["spread_pct"] == [20.0, 90.0] and abs(out[3]["p_clear"] - 0.426) < 0.001
    assert (out[4]["tier"], out[5]["clim_clear_pct"], out[6]["tier"]) == (0, 62.5, 0)
    assert [out[k]["label"] for k in (1, 3, 4, 5)] == ["forecast", "outlook (probabilistic)", "n/a", ""] and out[1]["clim_clear_pct"] == 62.5
    assert clouds.tiers(passes, ref) == {1, 2, 3} and not clouds.has_cloud(passes)
    nobody = weather.ensemble(table({"hourly": {"time": ["2026-07-08T00:00"], "cloud_cover": [None]}}))
    assert clouds.with_clouds(passes.where("k = 3"), f, nobody, clim, ref).first()["cloud"]["tier"] == 0
    assert [round(r["pct"], 3) for r in clouds.daily(f, ref).collect()] == [26.667]
    assert weather.fetched(spark, [("a", "u")], lambda url: (_ for _ in ()).throw(OSError())).count() == 0
    with pytest.raises(ValueError):
        weather.hindcast_url(0, 0, "a", "b", [8], "http://x")


def test_scenes_and_manoeuvres(spark):
    sets = spark.createDataFrame([("LANDSAT9", *element_set(49260, 10, 20)), ("SENTINEL2A", *element_set(40697, 60, 90))], "satellite string, line1 string, line2 string")
    start = sets.select(elements.epoch_us(sets.line1)).first()[0]
    page = {"features": [{"collection": "c", "properties": {"datetime": "2026-06-30T05:00:00Z", "platform": p, "eo:cloud_cover": c, "proj:centroid": {"lat": -20, "lon": 150}}} for p, c in (("landsat-9", 3), ("landsat-9", None), ("unknown", 2))] + [{"collection": "c", "properties": {"platform": "landsat-9", "eo:cloud_cover": 1}}]}
    s = weather.scenes(spark.createDataFrame([("a", json.dumps(page))], "aoi_id string, json string"))
    assert s.count() == 2 and start
    found = validation.scene_matches(s, sets).collect()
    assert all(abs(r["dt_s"]) <= 1200 for r in found)
    history = spark.createDataFrame([("S", *element_set(5, 10, 20)), ("S", *element_set(5, 10.985, 100, motion=15.19, epoch="26182.00000000")), ("T", *element_set(6, 1, 1))], "satellite string, line1 string, line2 string")
    changes = validation.orbit_changes(history)
    assert [r["manoeuvred"] for r in changes.collect()] == [True]
    assert "MANOEUVRE" in validation.manoeuvre_warnings(changes).first()["text"]


#: The keys the contract promises.
PASS_KEYS = set("satellite tca_utc off_nadir_deg sun_elev_deg max_off_nadir_aoi_deg slant_range_km tle_epoch_utc category operational node local_solar_time_h quality timing_sigma_s coverage_pct footprint_lonlat geometry".split())
SINGLE_KEYS = set("schema_version sensor aoi window_utc passes marginal nonoperational cloud_daily cloud_horizon_utc summary warnings params".split())
AOI_KEYS = set("name centroid_lat centroid_lon terrain_alt_m vertices_lonlat".split())
CLOUD_KEYS = set("tier label total_pct low_pct mid_pct high_pct p_clear threshold_pct spread_pct clim_clear_pct total_band_pct optical_obstruction_pct cirrus_flag likely_cloudy".split())


def command(tmp_path, *more, days="7"):
    (tmp_path / "a.kmz").write_bytes(kmz(*more))
    lines = "\n".join("\n".join(element_set(n, 40.0 * i, 72.0 * i)) for i, (_, n, _) in enumerate(catalog.PROFILES["dragonette"].satellites))
    (tmp_path / "t.txt").write_text(lines)
    return [str(tmp_path / "a.kmz"), "--days", days, "--start", "2026-07-01T00:00:00Z", "--tle-file", str(tmp_path / "t.txt"), "-o", str(tmp_path / "o.xlsx"), "--json", str(tmp_path / "o.json")]


def sheet(box, k):
    return "".join(ET.fromstring(box.read(f"xl/worksheets/sheet{k}.xml")).itertext())


def test_command_line(spark, tmp_path, capsys):
    args = command(tmp_path, square("=HYPERLINK(1)", -20, 150))
    assert cli.main(args, spark) == 0
    body = json.loads((tmp_path / "o.json").read_text())
    assert set(body) == SINGLE_KEYS and set(body["aoi"]) == AOI_KEYS
    rows = body["passes"] + body["marginal"] + body["nonoperational"]
    assert rows and all(set(r) == PASS_KEYS for r in rows)
    assert all(round(r["geometry"]["view_zenith_deg"], 1) == r["geometry"]["view_zenith_deg"] for r in rows)
    assert body["schema_version"] == "2.1" and body["aoi"]["name"] == "=HYPERLINK(1)" and body["cloud_daily"] == {} and body["cloud_horizon_utc"] is None
    assert body["sensor"]["operational"]["DRAG05"] is False and body["params"]["max_off_nadir_deg"] == 20 and body["params"]["sensor"] == "dragonette"
    assert body["summary"]["window_days"] == 7 and body["summary"]["total_opportunities"] == len(body["passes"] + body["marginal"])
    with zipfile.ZipFile(tmp_path / "o.xlsx") as box:
        names = [n for n in box.namelist() if n.startswith("xl/worksheets")]
        for n in names:
            ET.fromstring(box.read(n))
        assert b"COUNTIF" in box.read("xl/worksheets/sheet1.xml") and "Cloud label" not in sheet(box, 1)
        assert "20.00000 S, 150.00000 E" in sheet(box, len(names) - 1) and "From (UTC)" in sheet(box, len(names))
    assert cli.main([*args, "--days", "40"], spark) == 2 and cli.main([*args, "--cloud-threshold", "101"], spark) == 2
    (tmp_path / "t.txt").write_text("nothing")
    assert cli.main(args, spark) == 3
    assert b"<f>" not in workbook.workbook([("s", [["=1+1"]])])


def test_command_line_with_clouds(spark, tmp_path, capsys):
    args = [*command(tmp_path, square("AOI 1", -20, 150), square("Two", 10, 20)), "--all-polygons", "--cloud"]
    times = [f"2026-07-0{1 + h // 24}T{h % 24:02d}:00" for h in range(5 * 24)]
    (tmp_path / "w" / "forecast").mkdir(parents=True)
    (tmp_path / "w" / "forecast" / "AOI 1.json").write_text(json.dumps({"hourly": {"time": times, **{f"cloud_cover{k}": [20] * len(times) for k in ("", "_low", "_mid", "_high")}}}))
    (tmp_path / "w" / "climatology.json").write_text(json.dumps({"AOI 1": {"Jul": 60.0}, "_note": "x"}))
    assert cli.main([*args, "--cloud-files", str(tmp_path / "w")], spark) == 0
    body = json.loads((tmp_path / "o.json").read_text())
    one, two = sorted(body["aois"], key=lambda r: r["aoi"]["name"])
    assert set(body) == {"schema_version", "aois"} and set(one) == SINGLE_KEYS - {"schema_version"}
    assert one["cloud_daily"] == {f"2026-07-0{k}": 20.0 for k in range(1, 6)} and one["cloud_horizon_utc"] == "2026-07-06T00:00:00+00:00" and two["cloud_daily"] == {}
    rows = one["passes"] + one["marginal"] + one["nonoperational"]
    assert rows and all(set(r) == PASS_KEYS | {"cloud"} and set(r["cloud"]) == CLOUD_KEYS for r in rows)
    near = [r["cloud"] for r in rows if r["tca_utc"] < "2026-07-05T23"]
    assert near and all((c["tier"], c["total_pct"], c["optical_obstruction_pct"], c["clim_clear_pct"]) == (1, 20, 48, 60) for c in near)
    assert any("ensemble" in t for t in one["warnings"])
    with zipfile.ZipFile(tmp_path / "o.xlsx") as box:
        text = "".join(sheet(box, k) for k in (1, 2))
        assert "Cloud label" in text and "20/20/20" in text and "60%" in text and "Passes per AOI" in text


def test_element_history(spark, tmp_path):
    roster, path, now = catalog.roster_df(spark, ["landsat"]), str(tmp_path / "h"), 1_783_000_000_000_000
    asked = []

    def get(norad):
        asked.append(norad)
        return "\n".join(("NAME", *element_set(norad, 10, 20)))

    def broken(norad):
        raise OSError("down")

    take = lambda minutes, way: history.acquire(spark, roster, path, now + minutes * 60_000_000, way)
    with pytest.raises(RuntimeError):
        take(0, broken)
    sets, said = take(20, get)
    assert sorted(asked) == [39084, 49260] and not said and sets.count() == 2
    assert take(60, broken)[1] == [] and len(asked) == 2  # fresh: nobody is asked
    sets, said = take(20 + 500, broken)
    assert sets.count() == 2 and "could not be fetched (down)" in said[0]
    assert "failed 5 min ago" in take(20 + 505, get)[1][0] and len(asked) == 2  # cooling
    moved = lambda n: "\n".join(element_set(n, 10.985, 100, motion=15.19, epoch="26182.00000000"))
    sets, said = take(20 + 520, moved)
    assert sets.count() == 2 and len(said) == 2 and "MANOEUVRE" in said[0]
    assert spark.read.parquet(f"{path}/sets").count() == 4
    with pytest.raises(RuntimeError):
        history.acquire(spark, catalog.roster_df(spark, ["sentinel2"]), path, now, lambda n: "nothing")


def test_harness(spark):
    """Two scenes of one area against leads of one and two days; a null forecast and one too far away are no pairs."""
    at = lambda h: 1_783_000_000_000_000 // sky.HOUR_US * sky.HOUR_US + h * sky.HOUR_US
    scenes = spark.createDataFrame([("a", 1, "x", at(0) + 60_000_000, 10.0), ("a", 2, "y", at(9), 80.0), ("b", 3, "x", at(0), 5.0)], "aoi_id string, scene int, platform string, t_us long, observed double")
    series = spark.createDataFrame([("a", 0, at(0), 1, 20.0), ("a", 1, at(1), 1, 99.0), ("a", 0, at(0), 2, 40.0), ("a", 9, at(9), 1, None), ("a", 9, at(9), 2, 70.0)], "aoi_id string, idx int, t_us long, lead_days int, forecast double")
    totals, platforms, skilled = skill.harness(scenes, series)
    assert {r["aoi_id"]: (r["scenes"], r["pairings"], r["observed_cloud_mean"]) for r in totals.collect()} == {"a": (2, 3, 45.0), "b": (1, 0, 5.0)}
    assert platforms.count() == 3
    assert {r["lead_days"]: (r["n"], r["bias"], r["decision_accuracy"]) for r in skilled.collect()} == {1: (1, 10.0, 1.0), 2: (2, 10.0, 0.5)}


def test_climatology_build(spark, tmp_path):
    for year, n, cloud in ((2015, 5, 0), (2016, 15, 10), (2017, 15, 90)):
        (tmp_path / "name=Site 1" / f"year={year}").mkdir(parents=True)
        page = {"features": [{"collection": "c", "properties": {"datetime": f"{year}-07-{k + 1:02d}T00:00:00Z", "platform": "p", "eo:cloud_cover": cloud}} for k in range(n)]}
        page["features"].append({"collection": "c", "properties": {"datetime": f"{year}-01-01T00:00:00Z", "eo:cloud_cover": 1}})
        (tmp_path / "name=Site 1" / f"year={year}" / "1.json").write_text(json.dumps(page))
    seen = weather.archive(spark, str(tmp_path), 2016, 2020)
    assert seen.count() == 32 and "PartitionFilters: [isnotnull(year" in seen._jdf.queryExecution().toString()
    built = json.loads(weather.climatology_build(seen, 30.0, 20).first()["json"])
    assert built["Site 1"] == {"Jul": 50.0} and built["_threshold_pct"] == 30
    assert built["_sample_counts"]["Site 1"]["Jul"] == 30 and built["_sample_counts"]["Site 1"]["Jan"] == 2 and len(built["_sample_counts"]["Site 1"]) == 12
    assert json.loads(weather.search_body(1.5, 2.5, "a", "b", ["c"]))["intersects"]["coordinates"] == [2.5, 1.5]
    with pytest.raises(ValueError):
        weather.search_body(0, 0, "a", "b", [], 300)


def test_validation_report(spark, tmp_path):
    page = {"features": [{"collection": "c", "properties": {"datetime": f"2026-07-01T{h:02d}:00:00Z", "platform": "landsat-9", "proj:centroid": {"lat": -20, "lon": 150}}} for h in range(24)]}
    (tmp_path / "s.json").write_text(json.dumps(page))
    numbers = [n for p in ("landsat", "sentinel2") for _, n, _ in catalog.PROFILES[p].satellites]
    (tmp_path / "t.txt").write_text("\n".join("\n".join(element_set(n, 10, 20)) for n in numbers))
    out = {r["platform"]: r["n"] for r in validation.report(spark, str(tmp_path / "s.json"), str(tmp_path / "t.txt")).collect()}
    assert set(out) == {"landsat-9", None} and out[None] == out["landsat-9"] > 0
    (tmp_path / "t.txt").write_text("\n".join(element_set(numbers[0], 10, 20)))
    with pytest.raises(ValueError, match="SENTINEL2C"):
        validation.report(spark, str(tmp_path / "s.json"), str(tmp_path / "t.txt"))


def test_failures_are_told_apart(spark):
    found = spark.createDataFrame([("A", 0, 10, 2), ("A", 1, 10, 64), ("B", 0, 3, 64), ("B", 0, 3, 64), ("C", 0, 0, 0)], "satellite string, block int, bad_steps long, codes long")
    none = spark.createDataFrame([("C", element_set(1, 1, 1)[0])], "satellite string, line1 string")
    texts = sorted(r["text"] for r in passes.warnings(found, none, 1_782_777_600_000_000, 20).where("ord = 1").collect())
    assert len(texts) == 2 and "at all (codes 1, 6)" in texts[0] and "3 steps of the window (codes 6)" in texts[1]


def test_streaming(spark, tmp_path):
    from skyloom.streaming import updates

    rows = [(1, 10, 7000.0), (1, 10 + sky.DAY_US, 7000.2), (2, 5, 6900.0), (1, 11, 1.0)]
    spark.createDataFrame(rows, "norad long, epoch_us long, a_km double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("norad long, epoch_us long, a_km double").parquet(f"{tmp_path}/in")
    q = updates.element_changes(stream).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    out = sorted((r["norad"], r["epoch_us"]) for r in spark.sql("select * from changes").collect())
    assert out == [(1, 11), (1, 10 + sky.DAY_US)]


def test_a_file_beyond_the_limit_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kml, "MAX_BYTES", 100)
    (tmp_path / "a.kml").write_text("<kml/>")
    assert kml.read_kml(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.kml").write_text("<kml>" + " " * 200)
    with pytest.raises(Exception, match="at most 100 are allowed"):
        kml.read_kml(spark, str(tmp_path)).collect()
