"""Packing documents into sequences by linear grouping.

Texts become token ids and an end id; longer ones are cut into full pieces, of which the first may be
shorter. What is packed is only the histogram of piece lengths, at most one row a token of capacity, so the
driver plans with a bounded table whatever the number of documents:

1. lengths of LARGE and more are split into groups of equal cardinality and rounded up to their group's largest;
2. configurations of those few sizes are optimised as a linear programme (columns made by a knapsack) and rounded down;
3. actual lengths take the places of the rounded ones, in runs of equal lengths;
4. what is left over, and the small lengths, go best-fit, largest first, into the free space, or into new sequences.

The plan is a list of slots (length, range of ranks) -> (sequence, offset). A piece's rank among those of its length is its
rank within the task that made it plus the count of earlier tasks, so no length is ever gathered in one task.

Null or empty text: the end id alone. Null doc_id: packed like any other. Repeated rows are packed each. Texts of any length are encoded
whole and cut. Pieces of equal length are alike to the plan, so their order is that of tasks and rows. Empty
table: no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.llm.common import set_arrow_batches, stash

CAPACITY = 2048
END = 0
LARGE = CAPACITY // 3 + 1
GROUPS = 60
#: Longer runs without a change between white space and the rest are left to the slower library, which has no limit on them.
LONG_RUN = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@cache
def encoder(vocabulary: str):
    """ids(text) for a byte-level BPE in a tokenizers file: the same vocabulary as ranks where that file lies beside it, which is faster."""
    import os

    slow = cache(lambda: _slow(vocabulary))
    plain = lambda text: slow().encode(text, add_special_tokens=False).ids
    ranked = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranked):
        return plain
    import public_tokenizers
    import regex
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranked, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long_run = regex.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")
    return lambda text: plain(text) if len(text) >= LONG_RUN and long_run.search(text) else fast.encode_ordinary(text)


def _slow(vocabulary: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary)
    made.encode_special_tokens = True
    return made


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be short."""
    first = (n - 1) % CAPACITY + 1
    return [(0, first)] + [(s, CAPACITY) for s in range(first, n, CAPACITY)]


def _piecer(vocabulary: str):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(CAPACITY + 1, np.int64)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*ids_of(text or ""), END], "<u4")
                for k, (start, length) in enumerate(cut(len(ids))):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, int(seen[length])))
                    seen[length] += 1
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return pieces


def pieces_of(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row a piece with its length and its rank among those of that length within its task, in the shared folder."""
    set_arrow_batches(docs.sparkSession)
    return stash(docs.select("doc_id", "text").mapInArrow(_piecer(vocabulary or vocabulary_path()), PIECES), "pack")


def grouped(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Lengths, longest first, in groups of about equal cardinality."""
    share = sum(counts.values()) / groups
    out, held, full = [], [], 0
    for length in sorted(counts, reverse=True):
        held.append(length)
        full += counts[length]
        if full >= share:
            out.append(held)
            held, full = [], 0
    return out + [held] if held else out


def best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes."""
    worth, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        can = sizes <= room
        gains = np.where(can, value + worth[room - np.where(can, sizes, 0)], -1.0)
        k = int(gains.argmax())
        worth[room], taken[room] = worth[room - 1], -1
        if gains[k] > worth[room - 1] + 1e-12:
            worth[room], taken[room] = gains[k], k
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return float(worth[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): least bins for the demand as a linear programme with generated columns, rounded down."""
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    amount = demand / np.diag(columns)
    for _ in range(40 * len(sizes)):
        worth, pattern = best_pattern(inverse.sum(axis=0), sizes, capacity)
        if worth <= 1 + 1e-9:
            break
        move = inverse @ pattern
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * move, 0)
        amount[out] = step
        columns[:, out] = pattern
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    return [(columns[:, k].astype(np.int64), int(np.floor(amount[k] + 1e-9))) for k in range(len(sizes)) if amount[k] >= 1 - 1e-9]


class Plan:
    """Runs of bins that hold the same lengths, and the slots that fill them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self.bins = 0
        self.open: dict[int, list[list[int]]] = {}
        self.slots: list[tuple[int, int, int, int, int]] = []

    def put(self, length: int, first: int, times: int, offset: int) -> None:
        """The next ``times`` pieces of a length, one a bin from ``first``."""
        self.slots.append((length, self.used[length], times, first, offset))
        self.used[length] += times
        self.left[length] -= times

    def free(self, room: int, first: int, times: int) -> None:
        if room and times:
            self.open.setdefault(room, []).append([first, times])

    def configure(self, groups: list[list[int]], pattern: np.ndarray, times: int) -> None:
        """Bins of a configuration, each group's places taken by its longest pieces that are left, in runs of equal lengths."""
        places = [g for g, n in enumerate(pattern) for _ in range(n)]
        while times:
            chosen: list[int] = []
            most = times
            taken: dict[int, int] = {}
            for g in places:
                length = next((x for x in groups[g] if self.left[x] > taken.get(x, 0)), None)
                if length is not None:
                    chosen.append(length)
                    taken[length] = taken.get(length, 0) + 1
            if not chosen:
                return
            most = min(most, *(self.left[x] // n for x, n in taken.items()))
            at = 0
            for length in chosen:
                self.put(length, self.bins, most, at)
                at += length
            self.free(self.capacity - at, self.bins, most)
            self.bins += most
            times -= most

    def best_fit(self) -> None:
        """All that is left, longest first, where it leaves least room."""
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                room = min((r for r in self.open if r >= length), default=None)
                if room is None:
                    each = self.capacity // length
                    times = max(1, self.left[length] // each)
                    room = self.capacity
                    self.free(room, self.bins, times)
                    self.bins += times
                first, times = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
                n = min(times, self.left[length])
                self.put(length, first, n, self.capacity - room)
                self.free(room - length, first, n)
                self.free(room, first + n, times - n)


def planned(counts: dict[int, int], capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> Plan:
    """The slots for a histogram of lengths."""
    plan = Plan(counts, capacity)
    if full := counts.get(capacity):
        plan.put(capacity, 0, full, 0)
        plan.bins = full
    big = {k: v for k, v in counts.items() if large <= k < capacity}
    if big:
        parts = grouped(big, groups)
        sizes = np.array([g[0] for g in parts])
        demand = np.array([sum(big[x] for x in g) for g in parts], float)
        chosen = configurations(sizes, demand, capacity)
        for pattern, times in sorted(chosen, key=lambda c: -int(c[0] @ sizes)):
            plan.configure(parts, pattern, times)
    plan.best_fit()
    return plan


def _placer(slots: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            found = table[np.searchsorted(keys, (length << 48) | rank, side="right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            new = [pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def packed(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = pieces_of(docs, vocabulary)
    shares = stash(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "pack-shares")
    counts = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # CAPACITY rows at most
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    # Shares grow with the number of tasks, so they are joined by an exchange of the pieces' few numbers, not broadcast.
    ranked = pieces.join(shares.select("length", "task", before.alias("before")).hint("merge"), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placer(planned(counts).slots), PLACED)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
