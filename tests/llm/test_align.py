"""Alignment against a plain version that compares all ranges of bytes."""

import hashlib
from collections import defaultdict

from skyloom.llm import align

SCHEMA = "doc_id long, text string, a string, n_a long"
TEXTS = [
    "The cat sat on the mat.", "the cat sat on the mat", "été à Zürich 12345", "日本語のテキスト", "a\n\n\tb  c", "  leading", "trailing  ", "<s> </s> <|endoftext|> <unk>", "x" * 300,
    "emoji 😀 and ▁ marker", "▁", "\x00\x01", "ﬁne ﬂow", "é e", None, "", " ", "The cat sat on the mat.", "aaa bbb aaa bbb aaa", "Ünïcödé " * 40, "word " * 9000,
]


def plain(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(align.vocabulary_path())
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=align.piece_path())
    letters = align.byte_letters()
    docs, counts = [], defaultdict(int)
    for doc_id, text, *_ in rows:
        whole = (" " + (text or "")).encode()
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        raw_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            a, b, raw_a, raw_b = [], [], [], []
        at = lambda raw: [(sum(map(len, raw[:k])), sum(map(len, raw[: k + 1]))) for k in range(len(raw))]
        if len(a) > 1000:  # ends by one pass
            at = lambda raw: [(e - len(x), e) for x, e in zip(raw, __import__("itertools").accumulate(map(len, raw)), strict=True)]
        in_a, in_b = at(raw_a), at(raw_b)
        links, lo = [], 0
        for i, (s, e) in zip(a, in_a, strict=True):
            while lo < len(in_b) and in_b[lo][1] <= s:
                lo += 1
            k = lo
            while k < len(in_b) and in_b[k][0] < e:
                links.append((i, b[k]))
                k += 1
        ends = sorted({e for _, e in in_a} & {e for _, e in in_b})
        groups, start = [], 0
        for end in ends if len(a) < 1000 else []:
            groups.append(",".join(str(i) for i, r in zip(a, in_a, strict=True) if start < r[1] <= end) + "|" + ",".join(str(i) for i, r in zip(b, in_b, strict=True) if start < r[1] <= end))
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        docs.append((doc_id, len(a), len(b), len(ends), links, digest if len(a) < 1000 else None))
        for link in set(links):
            counts[link] += 1
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return {(d, n_a, n_b, g, len(ls), sum(counts[x] == best[x[0]] for x in ls), sum(counts[x] for x in ls), s) for d, n_a, n_b, g, ls, s in docs}, dict(counts)


def test_alignment(spark, monkeypatch):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "The cat", "", 0), (3, "日本語のテキスト", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, counts = plain(rows)
    got = {tuple(r) for r in align.aligned(docs).collect()}
    unsure = {r[0] for r in want if r[-1] is None}
    assert {r[:-1] + (None if r[0] in unsure else r[-1],) for r in got} == want
    assert {r[0]: r[1] for r in got}[10] == 0 and {r[0]: r[1] for r in got}[8] > 0  # the marker itself is lost by one of them
    assert {((r["a_id"], r["b_id"]), r["n_docs"]) for r in align.alignment(docs).collect()} == set(counts.items())


def test_small_buffers_give_the_same(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    keys = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)]
    key, n = align.merged(keys, [np.ones(len(k), np.int64) for k in keys])
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == {k: sum(k in set(x.tolist()) for x in keys) for k in key.tolist()}
    # Shards of an arbitrary cut, runs that reach over batches included.
    big = spark.range(0, 40000).selectExpr("(id * 7919) % 5000 + (((id * 31) % 7) << 32) AS key", "1L AS n")
    from skyloom.llm.common import shared_folder

    shards = big.repartitionByRange(3, "key").sortWithinPartitions("key").mapInArrow(align._write(shared_folder(spark, "t")), align.SHARD).collect()
    known = align.Counts([(r["first"], r["uri"]) for r in shards], None)
    want = {r["key"]: r["count"] for r in big.groupBy("key").count().collect()}
    asked = np.array(sorted(want))
    assert known.find(asked).tolist() == [want[k] for k in asked.tolist()] and len(shards) == 3
    tops = {}
    for r in shards:
        for i, m in zip(np.frombuffer(r["ids"], "<i8").tolist(), np.frombuffer(r["most"], "<i8").tolist(), strict=True):
            tops[i] = max(tops.get(i, 0), m)
    assert tops == {i: max(n for k, n in want.items() if k >> 32 == i) for i in range(7)}


def test_nothing(spark):
    assert align.aligned(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = align.aligned(spark.createDataFrame([(1, None, "", 1)], SCHEMA)).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "")
