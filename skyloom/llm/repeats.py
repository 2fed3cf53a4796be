"""Removal of long repeated byte strings, by interval expansion on a Burrows-Wheeler transform.

Every start of a 400-byte string belongs to one anchor: the least 32-byte substring (by hash) within the string, so equal strings
have equal anchors at equal places. The starts of one anchor occurrence are consecutive; the bytes they cover are
its segment. Spark groups anchors. Segments that occur twice as a whole are repeated throughout, and one copy stands for them.
Only anchors with different segments are looked at further. A string that two of their segments share reaches some way to
the left and to the right of the anchor, LENGTH bytes in all, so both hold one of PARTS shorter strings around it (``keys``);
segments that share no such key with another are dropped. The others, in blocks of bounded size, become one text
with a separator after each, and breadth-first backward extension on its transform gives the common prefix lengths of
neighbouring suffixes by increasing value. It stops at 400: what has no value by then is at least that long, so its
suffixes start repeated strings. Anchors whose segments exceed a block (a passage in very many documents) are settled by
counting hashes of their windows instead, which needs no bounded group.

Null text, or fewer than 400 bytes: nothing removed. Very long texts: whole, cut into segments like any other. Ties of the anchor's
hash go to the first place in the string, alike in equal strings. Null doc_id: handled like any other. Repeated rows are copies of each
other, so their texts of 400 bytes or more are removed whole. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import U64, set_arrow_batches, span_hashes, stash

LENGTH = 400
GRAM = 32
REACH = LENGTH - GRAM + 1
#: Keys of a segment. Each is LENGTH - (LENGTH - GRAM) / PARTS bytes long.
PARTS = 8
#: Bytes of an anchor's segments up to which they are transformed together.
BLOCK_BYTES = 1 << 20
#: About the bytes of segments, of several anchors, in one transform.
DEALT_BYTES = 1 << 18
#: A key that more rows hold than this, and more than a SPREAD-th of all counted rows, is joined by a broadcast.
OFTEN = 1000
SPREAD = 20_000
OCCURRENCES = "doc_id long, text_id long, anchor long, seg long, start int, size int, mark int"
SEGMENTS = "doc_id long, text_id long, anchor long, seg long, start int, size int, keys array<long>, body binary"
SPANS = "doc_id long, text_id long, start int, stop int"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, from running minima of blocks in both directions."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U64)
    full[:n] = values
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, segment hash, start, size and the anchor's place in the segment for each anchor occurrence of a text of LENGTH bytes or more."""
    at = np.arange(len(data) - GRAM + 1)
    grams = span_hashes(data, at, at + GRAM)
    least = sliding_least((grams & U64(0xFFFFFFFF00000000)) | at.astype(U64), REACH)
    anchor = (least & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:] - 1, [len(anchor) - 1]))
    stop = last + LENGTH
    return grams[anchor[first]], span_hashes(data, first, stop), first, stop - first, anchor[first] - first


def keys(data: np.ndarray, start: np.ndarray, size: np.ndarray, mark: np.ndarray) -> list[list[int]]:
    """For each segment, hashes of strings around its anchor, of which two segments with a common string of LENGTH bytes share one.

    If the common string begins between ``near`` and ``far`` bytes before the anchor, it holds all from ``near`` bytes before it
    to LENGTH - ``far`` bytes after its start.
    """
    out: list[list[int]] = [[] for _ in start]
    steps = (LENGTH - GRAM) * np.arange(PARTS + 1) // PARTS
    a, b = ((start + mark)[:, None] - steps[:-1]), ((start + mark)[:, None] + LENGTH - steps[1:])
    owner, part = np.nonzero((a >= start[:, None]) & (b <= (start + size)[:, None]))
    hashes = span_hashes(data, a[owner, part], b[owner, part]) + part.astype(U64)
    for k, h in zip(owner.tolist(), hashes.view(np.int64).tolist(), strict=True):
        out[k].append(h)
    return out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_id", "anchor", "seg", "start", "size", "mark"]
    for batch in batches:
        for doc_id, text_id, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_id", "raw")), strict=True):
            if raw is None or len(raw) < LENGTH:
                continue
            anchor, seg, start, size, mark = segments(np.frombuffer(raw, np.uint8))
            n = len(start)
            ids = pa.array([doc_id] * n, pa.int64()), pa.array([text_id] * n, pa.int64())
            arrays = [*ids, pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (start, size, mark))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols, by prefix doubling; ties in any order."""
    n = len(text)
    bits = (int(text.max(initial=0)) + 1).bit_length()
    width = max(1, 62 // bits)  # so many symbols fit in the first key
    key = np.zeros(n, np.int64)
    for k in range(min(width, n)):
        key[: n - k] |= (text[k:] + 1) << (bits * (width - 1 - k))
    while True:
        order = np.argsort(key)
        ordered = key[order]
        if width >= depth or width >= n:
            return order
        place = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if place[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = place
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        width *= 2


class Occurrences:
    """How often each symbol occurs before a place of the transform: counts at every STRIDE-th place, and what follows it."""

    STRIDE = 64

    def __init__(self, codes: np.ndarray, symbols: int):
        n, self.symbols = len(codes), symbols
        rows = n // self.STRIDE + 1
        within = np.bincount(np.arange(n) // self.STRIDE * symbols + codes, minlength=rows * symbols)[: rows * symbols].reshape(rows, symbols)
        self.before = np.zeros((rows + 1, symbols), np.int32)
        np.cumsum(within, axis=0, out=self.before[1:])
        self.codes = np.concatenate((codes, np.full(self.STRIDE, symbols)))

    def at(self, places: np.ndarray) -> np.ndarray:
        """A row a place, a column a symbol."""
        row, rest = np.divmod(places, self.STRIDE)
        tail = self.codes[(row * self.STRIDE)[:, None] + np.arange(self.STRIDE)]
        tail = np.where(np.arange(self.STRIDE) < rest[:, None], tail, self.symbols)
        wide = self.symbols + 1
        counts = np.bincount((np.arange(len(places))[:, None] * wide + tail).ravel(), minlength=len(places) * wide)
        return self.before[row] + counts.reshape(-1, wide)[:, :-1]


#: Intervals of more suffixes are extended by rank queries at their two ends, smaller ones by a look at each suffix: the same result.
SCANNED = 512


def bounded_prefixes(text: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """Common prefix lengths of neighbouring suffixes below ``bound``; -1 where they are at least that long.

    An interval of suffixes that share a prefix is extended to the left by each symbol that the transform holds there. The
    border after an extended interval has the shared length as its value if it has none yet; only then is that interval
    extended in turn. Intervals of equal prefix length are handled together, so values come in increasing order. Symbols from
    256 on are separators, each used once; what they begin shares nothing with its neighbours.
    """
    n = len(text)
    kinds = np.minimum(text, 256)
    counts = np.bincount(kinds, minlength=257)
    wide = int((counts > 0).sum())
    letters = wide - int(counts[256] > 0)  # separators have the last code
    before = (np.cumsum(counts > 0) - 1)[kinds][order - 1]
    first = np.concatenate(([0], np.cumsum(counts[counts > 0])))
    by_symbol = np.argsort(before.astype(np.uint16), kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)  # where a suffix goes when its preceding symbol is put before it
    ranks = Occurrences(before, wide)
    value = np.full(n + 1, -1, np.int64)
    value[0] = 0
    value[first[1:]] = 0
    value[first[letters] :] = 0
    alone = np.arange(first[letters], n)  # the suffixes that a separator begins
    low, high = np.concatenate((first[:letters], alone)), np.concatenate((first[1 : letters + 1], alone + 1))
    for shared in range(1, bound):
        sizes = high - low
        few = sizes <= SCANNED
        large_low, large_high = low[~few], high[~few]
        low, sizes = low[few], sizes[few]
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        key = owner * wide + before[at]  # what separators lead to has its value since the start, so they drop out below
        by = np.argsort(key, kind="stable")
        key, to = key[by], step[at[by]]
        edge = np.flatnonzero(key[1:] != key[:-1])
        start = np.concatenate(([0], edge + 1)) if len(key) else edge
        last = np.concatenate((edge, [len(key) - 1])) if len(key) else edge
        low, high = to[start], to[last] + 1
        if len(large_low):
            a, b = ranks.at(large_low)[:, :letters], ranks.at(large_high)[:, :letters]
            some = a < b
            low = np.concatenate((low, (a + first[:letters])[some]))
            high = np.concatenate((high, (b + first[:letters])[some]))
        new = value[high] < 0
        low, high = low[new], high[new]
        value[high] = shared
        if not len(low):
            break
    return value[:n]


def repeated_starts(bodies: list[bytes]) -> list[np.ndarray]:
    """For each body, which of its strings of LENGTH bytes start elsewhere in the bodies too."""
    sizes = [len(b) for b in bodies]
    text = np.empty(sum(sizes) + len(bodies), np.int64)
    begin = np.concatenate(([0], np.cumsum(np.array(sizes) + 1)))
    for k, body in enumerate(bodies):
        text[begin[k] : begin[k + 1] - 1] = np.frombuffer(body, np.uint8)
        text[begin[k + 1] - 1] = 256 + k  # separators differ, so that no string runs over one twice
    order = suffix_array(text, LENGTH)
    long = bounded_prefixes(text, order, LENGTH) < 0
    twice = np.zeros(len(text), bool)
    twice[order[long]] = True
    twice[order[np.flatnonzero(long) - 1]] = True
    return [twice[begin[k] : begin[k] + max(0, sizes[k] - LENGTH + 1)] for k in range(len(bodies))]


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges that the strings at the marked starts cover."""
    at = np.flatnonzero(starts)
    if not len(at):
        return []
    gap = np.flatnonzero(at[1:] - at[:-1] > LENGTH)
    return list(zip(at[np.concatenate(([0], gap + 1))].tolist(), (at[np.concatenate((gap, [len(at) - 1]))] + LENGTH).tolist(), strict=True))


def _transform(key, table):
    """Covered ranges of a block of segments."""
    rows = table.select(["doc_id", "text_id", "start", "body"]).to_pylist()
    found = repeated_starts([r["body"] for r in rows])
    out = [(r["doc_id"], r["text_id"], r["start"] + a, r["start"] + b) for r, marks in zip(rows, found, strict=True) for a, b in runs(marks)]
    return spans_table(out)


def spans_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "text_id", "start", "stop"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a string of LENGTH bytes: its hash and where it starts."""
    for batch in batches:
        for r in batch.to_pylist():
            data = np.frombuffer(r["body"], np.uint8)
            at = np.arange(len(data) - LENGTH + 1)
            n = len(at)
            ids = [pa.array([r[c]] * n, pa.int64()) for c in ("anchor", "doc_id", "text_id")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array((at + r["start"]).astype(np.int32)), pa.array(span_hashes(data, at, at + LENGTH).view(np.int64))], names=["anchor", "doc_id", "text_id", "start", "hash"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    names = ["doc_id", "text_id", "anchor", "seg", "start", "size", "keys", "body"]
    for batch in batches:
        for r in batch.to_pylist():
            wanted = r["wanted"]
            held = keys(np.frombuffer(r["raw"], np.uint8), *(np.array([w[c] for w in wanted], np.int64) for c in ("start", "size", "mark")))
            rows = [(r["doc_id"], r["text_id"], w["anchor"], w["seg"], w["start"], w["size"], k, r["raw"][w["start"] : w["start"] + w["size"]]) for w, k in zip(wanted, held, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.col("text").cast("binary").alias("raw"))


def same_document(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_id") == F.col(f"{b}.text_id"))


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join with a stored table unique in ``on``, whose ``n`` says how many of ``rows`` hold a key.

    Rows of common keys stay where they are read, as one task would get all rows of a key; fewer than SPREAD keys can be that common.
    """
    often = max(OFTEN, (counted.agg(F.sum("n")).first()[0] or 0) // SPREAD)
    common = counted.where(F.col("n") > often)
    usual = rows.join(F.broadcast(common.select(on)), on, "left_anti").join(counted.where(F.col("n") <= often), on)
    return rows.join(F.broadcast(common), on).unionByName(usual)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, start, stop): byte ranges covered by repeated strings; they may overlap."""
    spark = docs.sparkSession
    set_arrow_batches(spark, 128)
    occurrences = stash(keyed(docs).mapInArrow(_occurrences, OCCURRENCES), "repeats")
    place = F.struct("doc_id", "text_id", "start", "size", "mark")
    classes = stash(occurrences.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p")), "repeats-classes")
    twice = classes.where("n > 1").select("anchor", "seg", "n")
    whole = join_counted(occurrences, twice, ["anchor", "seg"]).select("doc_id", "text_id", "start", (F.col("start") + F.col("size")).alias("stop"))
    mixed = stash(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats-mixed")
    wanted = join_counted(classes.select("anchor", "seg", "p"), mixed, ["anchor"]).select("anchor", "seg", "p.*")
    by_doc = wanted.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("anchor", "seg", "start", "size", "mark")).alias("wanted"))
    texts = keyed(docs).alias("t").join(by_doc.alias("w"), same_document("t", "w")).select("t.doc_id", "t.text_id", "t.raw", "w.wanted")
    held = stash(texts.mapInArrow(_bodies, SEGMENTS).dropDuplicates(["anchor", "seg"]), "repeats-segments")
    rows = held.select("anchor", "seg", "size", F.explode("keys").alias("key"))
    shared = stash(rows.groupBy("anchor", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats-shared")
    live = stash(join_counted(rows, shared, ["anchor", "key"]).select("anchor", "seg", "size").distinct(), "repeats-live")
    total = live.agg(F.sum("size")).first()[0] or 0
    sums = stash(live.groupBy("anchor").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "repeats-sums")
    bodies = stash(held.drop("keys", "size").join(join_counted(live, sums, ["anchor"]).select("anchor", "seg", "bytes"), ["anchor", "seg"]), "repeats-bodies")
    blocks = max(1, total // DEALT_BYTES)
    # An explicit number: blocks cost far more than their bytes say, which is what partitions are merged by.
    tasks = min(blocks, max(blocks // 64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    usual = bodies.where(F.col("bytes") <= BLOCK_BYTES).withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    dealt = usual.select("block", "doc_id", "text_id", "start", "body").repartition(tasks, "block")
    parts = dealt.groupBy("block").applyInArrow(_transform, SPANS)
    windows = bodies.where(F.col("bytes") > BLOCK_BYTES).select("anchor", "doc_id", "text_id", "start", "body").mapInArrow(_windows, "anchor long, doc_id long, text_id long, start int, hash long")
    # Equal strings have equal anchors: with both as the key, 128 bits would have to agree by chance.
    counted = stash(windows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats-windows")
    rest = join_counted(windows, counted, ["anchor", "hash"]).select("doc_id", "text_id", "start", (F.col("start") + LENGTH).alias("stop"))
    return whole.unionByName(parts).unionByName(rest)


def without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the ranges, and how many separate runs those make."""
    kept, at, count, end = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            kept.append(raw[at:a])
            count += 1
            end = at = b
        elif b > end:
            end = at = b
    return b"".join(kept) + raw[at:], count


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string"


def _remover(with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
        for batch in batches:
            rows = []
            for doc_id, raw, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "raw", "spans")), strict=True):
                raw = raw or b""
                kept, count = without(raw, [(s["start"], s["stop"]) for s in spans or ()])
                rows.append((doc_id, len(raw), len(raw) - len(kept), count, hashlib.sha256(kept).hexdigest(), *((kept, kept.decode("utf-8", "replace")) if with_text else (None, None))))
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text"])

    return remove


def removed(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Figures of every document without its repeated strings, and what is left of it if asked for: its bytes (``kept``),
    and as a text, in which a character that lost some of its bytes is U+FFFD."""
    spans = repeated_spans(docs).groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = keyed(docs).alias("t").join(spans.alias("s"), same_document("t", "s"), "left").select("t.doc_id", "t.raw", "s.spans")
    return joined.mapInArrow(_remover(with_text), REMOVED)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=True).drop("kept")
