"""Reports written by tasks: their bytes are those of the whole document, and failed tasks leave none."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skyloom.sources import contract, report


def test_bytes_of_the_report(spark, tmp_path, monkeypatch):
    docs = [(f"r{k:03d}", json.dumps({"k": k, "text": "x" * (k * 37 % 900) + "é"}, ensure_ascii=False)) for k in range(100)]
    df = spark.createDataFrame(docs, "run_id string, json string").repartition(7)
    monkeypatch.setattr(report, "PIECE", 64)
    for n in (100, 1, 2):
        path = str(tmp_path / f"out-{n}.json")
        report.write_report(df.where(F.col("run_id") < f"r{n:03d}"), path)
        with open(path, encoding="utf-8") as f:
            assert f.read() == contract.root([d for _, d in docs[:n]])
    assert sorted(os.listdir(tmp_path)) == ["out-1.json", "out-100.json", "out-2.json"]


def test_parts_and_failures(spark, tmp_path):
    df = spark.range(40).select(F.format_string("r%02d", "id").alias("run_id"), F.format_string('{"k":%d}', "id").alias("json"))
    path = str(tmp_path / "parts")
    report.write_report(df, path, parts=True)
    with open(os.path.join(path, "_manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    lines = [line for m in manifest for line in open(os.path.join(path, m["part"]), encoding="utf-8")]
    assert sum(m["documents"] for m in manifest) == 40 and [json.loads(x)["k"] for x in lines] == list(range(40))
    broken = df.withColumn("json", F.when(F.col("run_id") == "r20", F.raise_error(F.lit("stop"))).otherwise(F.col("json")))
    with pytest.raises(Exception, match="stop"):
        report.write_report(broken, str(tmp_path / "never.json"))
    assert not os.path.exists(tmp_path / "never.json")
