"""Plans fill without gaps or overlaps, and pieces carry the ids of the tokenizers library."""

import math
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import packing


def lay(plan):
    """Bins as lists of (offset, length), from the slots."""
    bins = defaultdict(list)
    for length, _, times, first, offset in plan.slots:
        for k in range(times):
            bins[first + k].append((offset, length))
    return bins


def gapless(bins, capacity):
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity


@settings(deadline=None, max_examples=30)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=40))
def test_plans_hold_every_piece(counts):
    plan = packing.planned(counts, 64, 22, 12)
    bins = lay(plan)
    gapless(bins, 64)
    assert sum(len(b) for b in bins.values()) == sum(counts.values()) and plan.used == counts
    # No plan has fewer bins than the tokens need, or than there are pieces of over half a bin.
    least = max(math.ceil(sum(k * v for k, v in counts.items()) / 64), sum(v for k, v in counts.items() if k > 32))
    assert least <= len(bins) == plan.bins <= 1.5 * least + 3


def test_plans_are_tight():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6.3, 1.2, 40000).astype(int), 1, 2048)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.planned(counts)
    assert plan.bins <= 1.001 * math.ceil(lengths.sum() / 2048)


def test_pieces(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary_path())
    plain.encode_special_tokens = True
    rows = [(i, f"Text {i}, été 12 34\n\n  naïve! " * (i * 3 % 50), "x") for i in range(60)]
    rows += [(100, None, ""), (101, "", None), (102, "long text, " * 5000, ""), (103, " " * 150000, ""), (103, " " * 150000, ""), (None, "z", ""), (104, "日本語 " * 900, ""), (105, "<|endoftext|>", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = [r.asDict() for r in packing.packed(docs.repartition(5)).collect()]
    want = defaultdict(list)
    for doc_id, text, _ in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (start, length) in enumerate(packing.cut(len(ids))):
            want[doc_id].append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    gapless(bins, 2048)
    assert packing.packed(docs.limit(0)).count() == 0
