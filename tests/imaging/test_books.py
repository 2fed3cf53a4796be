"""Workbooks written by tasks hold what the workbook in memory holds, and failed tasks leave none."""

import io
import json
import os
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from skyloom.plans import queries
from skyloom.sources import books, workbook

FOLDER = "/root/testdata/sf0.001"
SATS = [f"SAT{k}" for k in range(10)]
HINTS = {"marginal": "to be confirmed", "nonoperational": "not in service"}


def inputs(spark, passes, runs):
    runs = spark.createDataFrame([(r,) for r in runs], "run_id string")
    counted = runs.select("run_id", F.posexplode(F.array(*[F.lit(s) for s in SATS])).alias("ord", "label"))
    notes = runs.select("run_id", F.lit(0).alias("ord"), F.lit("A & B").alias("item"), F.lit("=1+1").alias("value"))
    return books.workbook_rows(passes, runs, counted, notes, "Australia/Brisbane", HINTS)


def sheets(data: bytes) -> dict[str, str]:
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        assert box.testzip() is None
        return {n: box.read(n).decode() for n in box.namelist()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
def test_each_area_has_the_workbook_that_is_made_in_memory(spark, tmp_path):
    passes = queries.sheet_passes(spark, FOLDER).where("user_id < 12").cache()
    runs = sorted({r["run_id"] for r in passes.select("run_id").collect()}) + ["none/at all"]
    path = str(tmp_path / "books")
    books.write_books(inputs(spark, passes, runs), path)
    with open(os.path.join(path, "_manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    found = {name: os.path.join(path, m["part"], name) for m in manifest for name in os.listdir(os.path.join(path, m["part"]))}
    assert sum(m["books"] for m in manifest) == len(found) == len(runs) and set(found) == {books.file_name(r) for r in runs}
    for run in runs:
        own = passes.where(F.col("run_id") == run)
        lanes = [books.LANES, *[[r["satellite"]] for r in own.orderBy("tca_us").collect()]]
        want = sheets(workbook.report(own, ["one"], SATS, "Australia/Brisbane", [("A & B", "=1+1")], HINTS, lanes))
        with open(found[books.file_name(run)], "rb") as f:
            got = sheets(f.read())
        last = max(n for n in want if "sheet" in n and n.startswith("xl/worksheets/"))
        assert set(got) == set(want) and all(got[n] == want[n] for n in want if n != last)
        assert got[last].count("<row") == want[last].count("<row")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
def test_a_single_workbook_and_failures(spark, tmp_path):
    passes = queries.sheet_passes(spark, FOLDER).where("user_id < 5").withColumn("run_id", F.lit("all"))
    path = str(tmp_path / "one.xlsx")
    for _ in range(2):  # a second report takes the place of the first
        books.write_books(inputs(spark, passes, ["all"]), path, single=True)
        with open(path, "rb") as f:
            assert sheets(f.read())["xl/worksheets/sheet5.xml" if passes.where("bucket = 'nonoperational'").head(1) else "xl/worksheets/sheet4.xml"].count("<row") == passes.count() + 1
    assert os.listdir(tmp_path) == ["one.xlsx"]
    broken = inputs(spark, passes, ["all"]).withColumn("title", F.when(F.col("block") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="stop"):
        books.write_books(broken, str(tmp_path / "never.xlsx"), single=True)
    with pytest.raises(Exception, match="single workbook"):
        books.write_books(inputs(spark, passes, ["all", "other"]), str(tmp_path / "never.xlsx"), single=True)
    assert not os.path.exists(tmp_path / "never.xlsx")


def test_names_of_files():
    assert books.file_name(None) == "null.xlsx" and books.file_name("a/b c") == "a%2Fb%20c.xlsx"
    long = ["x" * 400, "x" * 399 + "y"]
    assert len({books.file_name(n) for n in long}) == 2 and all(len(books.file_name(n)) < 200 for n in long)


def test_marks_in_texts_stay_and_the_table_is_read_a_few_times(spark, tmp_path):
    names = ["<#> & <last>", "&lt;#&gt;{here}", None]
    at = lambda c: F.get(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 3).cast("int")).alias(c)
    events = spark.range(700).select(F.col("id").alias("event_id"), F.lit(7).alias("user_id"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    passes = queries.sheet_passes(spark, str(tmp_path)).withColumns({"name": at("name"), "slant_range_km": F.col("event_id") * 1e6}).withColumn("run_id", F.lit("r"))
    runs = spark.createDataFrame([("r",)], "run_id string")
    counted = runs.select("run_id", F.lit(0).alias("ord"), F.lit("<#>{last}").alias("label"))
    rows = books.workbook_rows(passes, runs, counted, runs.select("run_id", F.lit(0).alias("ord"), F.lit("<top>").alias("item"), F.lit(None).cast("string").alias("value")), "UTC", HINTS, with_aoi=True)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 3
    books.write_books(rows, str(tmp_path / "one.xlsx"), single=True)
    with open(tmp_path / "one.xlsx", "rb") as f:
        got = sheets(f.read())
    want = sheets(workbook.report(passes, ["<#>{last}", "b"], [], "UTC", [("<top>", None)], HINTS, [books.LANES]))
    shape = lambda x: [re.sub("(?<=<v>)[^<]+", lambda m: repr(float(m[0])), r) for r in x.split("</row>")]
    for n in ("xl/worksheets/sheet2.xml", "xl/worksheets/sheet3.xml"):
        assert shape(got[n]) == shape(want[n])
    one, other = shape(got["xl/worksheets/sheet1.xml"]), shape(want["xl/worksheets/sheet1.xml"])
    assert one[:-3] == other[: len(one) - 3] and len(one) > 100 and "&lt;#&gt;{last}" in one[-3]
    lanes = [re.search('r="B[0-9]+".*?preserve">(.*?)</t>', r) for r in got["xl/worksheets/sheet4.xml"].split("</row>")[1:-1]]
    assert {m and m[1] for m in lanes} == {"&lt;#&gt; &amp; &lt;last&gt;", "&amp;lt;#&amp;gt;{here}", None}
