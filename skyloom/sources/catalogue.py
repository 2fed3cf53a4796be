"""A scene catalogue as a Spark data source: one input partition a place and year, opened only if the query needs it.

    spark.dataSource.register(SceneCatalogue)
    spark.read.format("scene_catalogue").options(folder=..., first=2016, last=2025).load().where("year >= 2020")

Pages come from a ``getter`` ("module:function", called with the place's name, the year, the search as JSON and the number of the page, and giving
JSON or None after the last), or from captures below ``folder``, in ``name=.../year=.../`` with a page a line.
``places`` is a JSON list of objects with name, lat and lon; without it, they are the names that the folder has. Filters on name and year are
pushed into the choice of partitions (with spark.sql.python.filterPushdown.enabled). A partition gives its scenes in order of time;
features without a time or, unless need_cloud is false, without cloud cover are dropped, as is a page that can't be read as JSON.
"""

from __future__ import annotations

import calendar
import json
from collections.abc import Iterator
from datetime import datetime, timezone
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from skyloom.sources.weather import search_body

SCHEMA = "name string, year int, t_us long, platform string, collection string, observed double, lat double, lon double"
_TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}


class Place(InputPartition):
    """A place and a year."""

    def __init__(self, name: str, year: int, lat: float | None, lon: float | None):
        self.name, self.year, self.lat, self.lon = name, year, lat, lon


def located(folder: str):
    """(pyarrow file system, path) of a folder."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def stored_pages(folder: str, name: str, year: int) -> Iterator[str]:
    """The pages kept of a place and year, none if there is no such folder."""
    from pyarrow import fs

    system, root = located(folder)
    kept = system.get_file_info(fs.FileSelector(f"{root}/name={name}/year={year}", allow_not_found=True))
    for path in sorted(f.path for f in kept if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))):
        with system.open_input_stream(path) as text:
            yield from text.read().decode("utf-8", "replace").splitlines()


def time_us(text) -> int | None:
    """Microseconds of an ISO time, UTC if it names no zone; None if it is none."""
    try:
        at = datetime.fromisoformat(str(text).replace("Z", "+00:00"))
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return calendar.timegm(at.utctimetuple()) * 1_000_000 + at.microsecond


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.getter = options.get("folder"), options.get("getter")
        if not self.folder and not self.getter:
            raise ValueError("a folder of captures or a getter is needed")
        self.first, self.last, self.limit = int(options.get("first", 2016)), int(options.get("last", 2025)), int(options.get("limit", 200))
        self.collections = json.loads(options.get("collections", "[]"))
        self.need_cloud = options.get("need_cloud", "true").lower() == "true"
        self.places = json.loads(options["places"]) if options.get("places") else None
        search_body(0.0, 0.0, "", "", self.collections, self.limit)  # a limit out of range is refused here
        self.wanted: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if type(one) in _TESTS and one.attribute in (("name",), ("year",)):
                self.wanted.append((one.attribute[0], type(one), one.value))
            else:
                yield one

    def _places(self) -> list[dict]:
        from pyarrow import fs

        if self.places is not None:
            return self.places
        if not self.folder:
            raise ValueError("a getter needs the places")
        system, root = located(self.folder)
        return [{"name": f.base_name.removeprefix("name=")} for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("name=")]

    def partitions(self) -> list[InputPartition]:
        every = [Place(str(p["name"]), year, p.get("lat"), p.get("lon")) for p in self._places() for year in range(self.first, self.last + 1)]
        return [p for p in every if all(_TESTS[kind](getattr(p, column), value) for column, kind, value in self.wanted)]

    def pages(self, place: Place) -> Iterator[str]:
        if not self.getter:
            yield from stored_pages(self.folder, place.name, place.year)
            return
        module, _, function = self.getter.partition(":")
        get = getattr(import_module(module), function)
        body = search_body(place.lat, place.lon, f"{place.year}-01-01T00:00:00Z", f"{place.year}-12-31T23:59:59Z", self.collections, self.limit)
        number = 0
        while (page := get(place.name, place.year, body, number)) is not None:
            yield page
            number += 1

    def read(self, place: Place) -> Iterator[tuple]:
        rows = []
        for page in self.pages(place):
            try:
                features = json.loads(page).get("features") or []
            except (ValueError, AttributeError):
                continue
            for f in features:
                p = f.get("properties") or {}
                at, cloud, centre = time_us(p.get("datetime")), p.get("eo:cloud_cover"), p.get("proj:centroid") or {}
                if at is not None and (cloud is not None or not self.need_cloud):
                    number = lambda v: None if v is None else float(v)
                    rows.append((place.name, place.year, at, p.get("platform"), f.get("collection"), number(cloud), number(centre.get("lat")), number(centre.get("lon"))))
        # A year's scenes of a place, some thousand at most.
        yield from sorted(rows, key=lambda r: (r[2], r[3] or ""))


class SceneCatalogue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scene_catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogueReader:
        return CatalogueReader(dict(self.options))


def catalogue(spark: SparkSession, **options):
    """Scenes of a catalogue, with filters pushed into the choice of places and years."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SceneCatalogue)
    return spark.read.format("scene_catalogue").options(**{k: str(v) for k, v in options.items()}).load()
