"""The scene catalogue as a data source, and damaged or malformed element sets."""

import json
import os

import pytest

from skyloom.operators import validation
from skyloom.sources import catalogue, history
from tests.imaging.test_orbits import element_set


def page(*times, cloud=5):
    return json.dumps({"features": [{"collection": "c", "properties": {"datetime": t, "platform": "p", "eo:cloud_cover": cloud, "proj:centroid": {"lat": 1, "lon": 2}}} for t in times]})


def put(folder, name, year, *lines):
    path = os.path.join(folder, f"name={name}", f"year={year}")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.txt"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines))


def test_places_and_years_are_partitions_in_order_of_time(spark, tmp_path):
    folder = str(tmp_path)
    put(folder, "A", 2020, page("2020-05-01T00:00:00Z", "2020-01-02T03:04:05.5Z"), "{damaged", page("2020-03-01T00:00:00+02:00", "no time"), page("2020-02-01", cloud=None))
    put(folder, "A", 2021, page("2021-01-01T00:00:00Z"))
    put(folder, "B", 2020, page("2020-07-01T00:00:00Z"))
    every = catalogue.catalogue(spark, folder=folder, first=2019, last=2021)
    assert every.rdd.getNumPartitions() == 6 and every.count() == 5
    rows = every.where("name = 'A' and year = 2020").collect()
    assert [r["t_us"] for r in rows] == sorted(r["t_us"] for r in rows) and rows[0]["t_us"] == 1577934245500000 and len(rows) == 3
    assert catalogue.catalogue(spark, folder=folder, first=2020, last=2020, need_cloud="false").count() == 5
    with pytest.raises(Exception, match="1 to 200"):
        catalogue.catalogue(spark, folder=folder, limit=900).count()


def test_partitions_not_asked_for_are_not_opened(spark, tmp_path):
    folder = str(tmp_path)
    put(folder, "A", 2020, page("2020-05-01T00:00:00Z"))
    os.makedirs(os.path.join(folder, "name=A", "year=2021"))
    os.symlink("/nowhere/at/all", os.path.join(folder, "name=A", "year=2021", "part-0.txt"))
    asked = catalogue.catalogue(spark, folder=folder, first=2020, last=2021).where("year < 2021 and name in ('A', 'B')")
    assert asked.rdd.getNumPartitions() == 1 and asked.count() == 1
    reader = catalogue.CatalogueReader({"getter": "tests.imaging.test_catalogue:answered", "places": json.dumps([{"name": "X", "lat": 1.0, "lon": 2.0}]), "first": "2020", "last": "2020", "limit": "7"})
    (place,) = reader.partitions()
    assert [r[2] for r in reader.read(place)] == [1577836800000000, 1580515200000000, 1583020800000000]


def answered(name, year, body, number):
    asked = json.loads(body)
    assert (name, asked["limit"], asked["intersects"]["coordinates"]) == ("X", 7, [2.0, 1.0])
    return page(f"{year}-0{3 - number}-01T00:00:00Z") if number < 3 else None


def test_malformed_sets_and_damaged_files_stop_nothing(spark, tmp_path):
    one, two = element_set(1, 0, 0, epoch="24001.00000000"), element_set(1, 0, 0, epoch="24003.00000000", motion=15.1)
    rows = [("S", *one), ("S", *two), ("S", "1 broken", "2 broken"), ("T", one[0], "2 00001 nonsense"), ("T", two[0], "")]
    out = validation.orbit_changes(spark.createDataFrame(rows, "satellite string, line1 string, line2 string")).collect()
    assert [(r["satellite"], round(r["gap_days"], 6), r["manoeuvred"]) for r in out] == [("S", 2.0, True)]
    path = str(tmp_path / "sets")
    spark.createDataFrame([("S", 1, *one, 5)], history.SETS).coalesce(1).write.parquet(path)
    with open(os.path.join(path, "part-damaged.parquet"), "wb") as f:
        f.write(b"PAR1 this is no Parquet file PAR1")
    assert history.stored(spark, path, history.SETS).count() == 1
