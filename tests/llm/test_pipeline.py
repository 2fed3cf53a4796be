"""The stages together, against plain versions of their decisions."""

import re


def test_stages(spark, tmp_path):
    import corpus_pipeline

    prose = lambda seed, n: " ".join(f"{chr(97 + (seed * 7 + k) % 26)}w{seed}x{k}" for k in range(n))
    rows = [(i, prose(i, 60 + i), "en", f"src{i % 3}", 0) for i in range(30)]
    rows += [(100, prose(3, 63), "en", "src0", 0), (101, prose(3, 63) + " end", "en", "src1", 0), (102, "too short", "en", "src1", 0), (103, None, "en", None, 0)]
    rows += [(104, prose(50, 80) + " me@here.org", "de", None, 0)]
    docs = spark.createDataFrame([(a, b, c, d, len(b or "")) for a, b, c, d, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r.asDict() for r in at.collect()]
    assert sorted(r["doc_id"] for r in seen["quality"]) == [*range(30), 100, 101, 104]
    assert sorted(r["doc_id"] for r in seen["near_dedup"]) == [*range(30), 104]
    assert next(r["text"] for r in seen["pii"] if r["doc_id"] == 104).endswith(" <EMAIL>")
    assert all(len(r["text"]) == r["n_chars"] for r in seen["pii"])
    assert {r["doc_id"] for r in seen["mixing"]} <= {r["doc_id"] for r in seen["pii"]}
    words = lambda rs: sum(len(re.findall(r"\S+", r["text"])) for r in rs)
    assert abs(words(seen["mixing"]) - words(seen["pii"])) < 500
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == sorted(r["doc_id"] for r in seen["mixing"])


def test_stages_keep_null_ids_and_judge_by_source(spark, tmp_path):
    import corpus_pipeline

    menu, own = " ".join(f"menu{k}x" for k in "abcdefghijklmnopqrst"), " ".join(f"{k}own" for k in "abcdefghijklmnopqrstuvwxy")
    rows = [(i, menu + f"\nonly {i} here", "en", "host", 0) for i in range(30)]
    rows += [(300, menu + "\nshort", "en", s, 0) for s in ("host", "elsewhere")] + [(None, own, "en", None, 0)]
    at = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(((r["doc_id"], r["source"]) for r in at.collect()), key=str) == [(300, "elsewhere"), (None, None)]
