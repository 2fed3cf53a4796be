"""Removed bytes against counting every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.llm import repeats


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    passages = [text(n) for n in (380, 399, 401, 500, 1500)]
    rows = [(i, text(rng.randint(0, 300)) + "".join(rng.choice(passages) + text(rng.choice([0, 5, 200])) for _ in range(rng.randint(0, 3)))) for i in range(120)]
    rows += [(200, rows[5][1]), (201, None), (202, ""), (203, "a" * 5000), (204, "ab" * 450), (205, text(3000)), (205, text(10)), (None, passages[4])]
    rows += [(300, "xyz" + passages[3] + text(900)), (300, "xyz" + passages[3] + text(900)), (301, rows[-1][1])]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 4000])
def test_matches_counting(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    rows = sample()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")
    out = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.removed(docs).collect()), key=repr)
    assert out == brute(rows, 400)
    assert repeats.removed(docs.limit(0)).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), st.integers(1, 12), st.sampled_from([0, 3, 256]))
def test_bounded_prefixes(bodies, bound, scanned):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(repeats, "SCANNED", scanned)
        prefixes(bodies, bound)


def prefixes(bodies, bound):
    text = np.concatenate([np.append(np.frombuffer(b, np.uint8).astype(np.int64), 256 + k) for k, b in enumerate(bodies)])
    order = repeats.suffix_array(text, 64)
    value = repeats.bounded_prefixes(text, order, bound)
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = min(len(a), len(b))
        same = int(np.argmin(np.append(a[:n] == b[:n], False)))
        assert value[k] == (same if same < bound else -1)


@pytest.mark.parametrize("often", [0, 2])
def test_common_keys(spark, monkeypatch, often):
    monkeypatch.setattr(repeats, "OFTEN", often)
    monkeypatch.setattr(repeats, "SPREAD", 1 << 40)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 4000)
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.removed(docs).collect()), key=repr)
    assert out == brute(rows, 400)


def test_copies_are_dealt(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(400))
    docs = spark.range(4000, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit(passage).alias("text"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # or Spark broadcasts so small a table on its own
    try:
        held = [r["count"] for r in repeats.repeated_spans(docs).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert sum(held) == 4000
    assert max(held) <= 2000  # not all of a passage's places in one task
