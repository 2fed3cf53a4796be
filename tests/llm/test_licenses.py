"""The scan against a plain one that tries every notice at every word."""

import random

import pytest

from skyloom.llm import licenses

SCHEMA = "doc_id long, text string, base string, word long"


def plain(text):
    words = licenses.split(text or "")
    base = sorted((label, i) for phrase, label in licenses.PHRASES for p in [licenses.split(phrase)] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)
    found = []
    for label, notice, keys in licenses.NOTICES:
        t = licenses.split(notice)
        places = {}
        for key in map(licenses.split, keys):
            s = next(s for s in range(len(t)) if t[s : s + len(key)] == key)
            places |= {s + i: w for i, w in enumerate(key)}
        for start in range(-len(t) + 1, len(words)):
            there = [start + q < len(words) and start + q >= 0 and words[start + q] == w for q, w in enumerate(t)]
            if all(there[q] for q in places) and sum(there) / len(t) >= licenses.SHARE:
                found.append((label, start, len(t), sum(there) / len(t)))
    return len(words), base, sorted(found)


def made():
    rng = random.Random(3)
    filler = "The quick été 日本語 license of and version 2 0 3 mit apache cc by gnu public general permission software x1 2.0".split()
    texts = [None, "", " \n ", "MIT License", "CC-BY", "cc by nc 4.0 cc by", "É MIT\x00LICENSE", "mit licenses", "Émit license", "gnu general public license gnu general public license"]
    texts += [notice for _, notice, _ in licenses.NOTICES]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choices(filler, k=rng.randint(0, 30))
            words = rng.choice(licenses.NOTICES)[1].split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(filler)
            parts += words[rng.choice([0, 0, 0, 2]) : rng.choice([None, None, -1])]
        texts.append(rng.choice([" ", "\n// ", " * "]).join(parts))
    texts.append("word " * 30000 + "Released under the MIT License. " * 2000)
    return texts


def test_scan(spark):
    texts = made()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "MIT License", "", 0), (12, texts[12], "", 0)]
    got = licenses.scanned(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for r in got:
        base = sorted((b["label"], b["word"]) for b in r["base"])
        notices = sorted((n["label"], n["word"], n["n_words"], n["share"]) for n in r["notices"])
        n, want_base, want = plain(text[r["doc_id"]]) if r["doc_id"] != len(texts) - 1 else (40000, [("mit", 30003 + 5 * k) for k in range(2000)], None)
        assert (r["n_words"], base) == (n, want_base)
        if want is None:
            assert len(notices) == 4000 and {x[3] for x in notices} == {1.0, 0.8}
        else:
            assert [x[:3] for x in notices] == [x[:3] for x in want] and [x[3] for x in notices] == pytest.approx([x[3] for x in want])


def test_query(spark, tmp_path):
    rows = [(1, "Licensed under CC BY-NC 4.0.", "", 0), (2, "Plain text", "", 0), (3, "the Apache License and the MIT license", "", 0), (4, None, "", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.op13_licenses(spark, str(tmp_path)).collect()}
    assert got[1] == (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0", 1.0, 1)
    assert got[2] == (2, 0, None, None, "", "", 0.0, 0) and got[4] == (0, 0, None, None, "", "", 0.0, 0)
    assert got[3] == (7, 2, 1, 5, "apache,mit", "apache,mit", 0.0, 0)
    assert licenses.scanned(spark.createDataFrame([], SCHEMA)).count() == 0


def test_notices_hold_their_key_phrases():
    with pytest.raises(ValueError, match="lacks"):
        licenses.Index([("x", "some words", ("other words",))])
    # The order of postings follows document frequencies and changes nothing else.
    common = licenses.Index(frequency={"mit": 10**6})
    ids = common.vocabulary.ids(*licenses.words_of("Released under the MIT License. Émit license".encode()))
    assert common.places(ids) == licenses.Index().places(ids)
