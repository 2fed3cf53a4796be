"""Interpolated modified Kneser-Ney n-gram model of any order, counted in Spark and memory-mapped for scoring.

Words and n-grams are counted as sorted arrays of 64-bit hashes. A task counts its part of the corpus, cuts the sorted
array at bucket borders and hands the packed pieces to Spark, which groups them by bucket; a bucket's pieces
are merged and written to the shared folder as one sorted array of hashes and one of counts. The id of a word or n-gram is
its place in the arrays of its order; an n-gram's hash is a bijective mix of the id of the n-gram before its last word and the
last word's id, so both come back from it. From the highest order down, each order gives discounts (from how many of its
n-grams have a count of one to four) and, for the order below, the total and discount mass per context and the number of
different words before each n-gram. Workers map these arrays and look up a batch of texts at once.

p(w | h) = (c(h w) - D(c)) / t(h) + mass(h) / t(h) * p(w | h without its first word), where c is the count at the highest order;
below it, c is the number of different words before (h w), or the count where (h w) begins a text, and t(h) the sum of c over w.
At the end, q(w) = (n(w) - D'(n)) / n + mass' / n / (V + 1), where n(w) counts different words before w. An unknown context
leaves the lower order. Every text ends in an end token, which is scored; its first words have shorter contexts.

Limits: fewer than 2**32 different words, and an n-gram's two ids must fit in 64 bits, which is tested. Null or empty text: the
end token alone. Null doc_id: held out. Repeated rows count each. Texts of any length are counted and scored whole, one at a time. Nothing is ranked, so there are no ties. Empty table: no rows; no training texts: probabilities of an
empty model. Other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import U64, file_system, mix64, set_arrow_batches, shared_folder, span_hashes, stash, word_spans
from skyloom.llm.shards import KEPT, mapped

#: Hashes that stand for the start and the end of a text.
START, FINISH = U64(0x9D39247E33776D41), U64(0x2AF7398005AAA5C7)
#: Entries that a task holds before it merges them, and about how many tokens' pairs go to one bucket.
HELD = 4_000_000
BUCKET_TOKENS = 8_000_000
#: Bytes of text to a bucket of words.
BUCKET_BYTES = 48_000_000
#: N-grams of a bucket that are worked on at once.
SLICE = 1 << 20
#: Values of a packed array that have a code of a byte.
FREQUENT = 255
#: The order of op3_lm.
ORDER = 3
PIECES = "bucket int, keys binary, counts binary"
SIDES = "bucket int, side int, keys binary, counts binary"
ADD = 0.1


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of mix64."""
    x = x ^ (x >> U64(31)) ^ (x >> U64(62))
    x = x * U64(pow(0x94D049BB133111EB, -1, 2**64))
    x = x ^ (x >> U64(27)) ^ (x >> U64(54))
    x = x * U64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


def squeezed(values: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype(U64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread(raw: bytes) -> np.ndarray:
    """The inverse of ``squeezed``."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(U64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not keys:
        return np.zeros(0, U64), np.zeros(0, U64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(count, first) if len(first) else count


def borders(buckets: int) -> np.ndarray:
    """The first hash of each bucket."""
    return np.array([k * 2**64 // buckets for k in range(buckets)], U64)


class Counter:
    """Counts of a task, merged now and then."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, hashes: np.ndarray) -> None:
        key, count = np.unique(hashes, return_counts=True)
        self.keys.append(key)
        self.counts.append(count.astype(U64))
        self.held += len(key)
        if self.held > HELD and len(self.keys) > 1:
            key, count = merged(self.keys, self.counts)
            self.keys, self.counts, self.held = [key], [count], 0 if len(key) > HELD // 2 else len(key)

    def pieces(self, buckets: int) -> Iterator[pa.RecordBatch]:
        key, count = merged(self.keys, self.counts)
        self.keys = self.counts = None
        cuts = [*np.searchsorted(key, borders(buckets)), len(key)]
        for k in range(buckets):
            a, b = cuts[k], cuts[k + 1]
            if b > a:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int32()), "keys": [squeezed(np.diff(key[a:b], prepend=U64(0)))], "counts": [squeezed(count[a:b])]})


def hashed(raw: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts one after another, each with START before and FINISH after it; and the texts' first places."""
    parts, starts, at = [], [], 0
    for text in raw:
        data = np.frombuffer((text or b"").lower(), np.uint8)
        words = span_hashes(data, *word_spans(data))
        parts += [[START], words, [FINISH]]
        starts.append(at)
        at += len(words) + 2
    return np.concatenate([np.asarray(p, U64) for p in parts]) if parts else np.zeros(0, U64), np.array(starts, np.int64)


def _words(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter()
        for batch in batches:
            own.add(hashed(batch.column("raw").to_pylist())[0])
        yield from own.pieces(buckets)

    return count


def write_array(uri: str, values: np.ndarray) -> None:
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    spare = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"  # a task may run twice
    with system.open_output_stream(spare) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    system.move(spare, path)


def write_packed(uri: str, values: np.ndarray) -> None:
    """An array of 8-byte values as a byte each: its place among the FREQUENT most frequent values, which are kept with it; the others are listed."""
    bits = np.ascontiguousarray(values).view(U64)
    seen, code, count = np.unique(bits, return_inverse=True, return_counts=True)
    usual = np.sort(np.argsort(-count, kind="stable")[:FREQUENT])
    place = np.full(len(seen), FREQUENT, np.uint8)
    place[usual] = np.arange(len(usual))
    code = place[code]
    rare = np.flatnonzero(code == FREQUENT)
    write_array(f"{uri}.usual", seen[usual])
    write_array(f"{uri}.rare", np.concatenate((rare.astype(U64), bits[rare])))
    write_array(uri, code)


class Packed:
    """A memory-mapped array of ``write_packed``; places in it give values."""

    def __init__(self, uri: str, kind: str):
        self.code, self.usual, rare = mapped(uri, "u1"), mapped(f"{uri}.usual", "u8"), mapped(f"{uri}.rare", "u8")
        self.kind, self.places, self.values = kind, rare[: len(rare) // 2], rare[len(rare) // 2 :]

    def at(self, places: np.ndarray) -> np.ndarray:
        code = np.asarray(self.code[places])
        out = np.zeros(len(code), U64)
        usual = code < FREQUENT
        out[usual] = self.usual[code[usual]]
        out[~usual] = self.values[np.searchsorted(self.places, places[~usual].astype(U64))]
        return out.view(self.kind)

    def part(self, start: int, stop: int) -> np.ndarray:
        return self.at(np.arange(start, min(stop, len(self.code))))


@lru_cache(maxsize=KEPT)
def packed(uri: str, kind: str = "u8") -> Packed:
    return Packed(uri, kind)


def _merge(folder: str, name: str):
    """Merges a bucket's pieces and writes its arrays; a row with its size, total, and how many keys have each small count."""

    def merge(key, table):
        keys = [np.cumsum(spread(x), dtype=U64) for x in table.column("keys").to_pylist()]
        hashes, counts = merged(keys, [spread(x) for x in table.column("counts").to_pylist()])
        bucket = key[0].as_py()
        write_array(f"{folder}/{name}-{bucket}.keys", hashes)
        write_packed(f"{folder}/{name}-{bucket}.counts", counts)
        small = np.bincount(np.minimum(counts, U64(5)).astype(np.int64), minlength=6)[1:5]
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "size": [len(hashes)], "total": [int(counts.sum())], **{f"n{i + 1}": [int(x)] for i, x in enumerate(small)}})

    return merge


SIZES = "bucket int, size long, total long, n1 long, n2 long, n3 long, n4 long"


class Grams:
    """Arrays of all buckets of the n-grams of one order (words: 1); ids are places in them, in bucket order."""

    def __init__(self, folder: str, order: int, sizes: list[int]):
        self.folder, self.name, self.sizes = folder, named(order), sizes
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.borders = borders(len(sizes))

    def find(self, hashes: np.ndarray, *arrays: tuple[str, str]) -> list[np.ndarray]:
        """Id (-1: unknown) of each hash, and its values (0 for unknown ones) in the arrays of these names and kinds."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, values = np.full(len(distinct), -1, np.int64), [np.zeros(len(distinct), kind) for _, kind in arrays]
        for k, a, b, at in located(self.folder, self.name, self.sizes, self.borders, distinct):
            hit = at >= 0
            ids[a:b][hit] = self.first[k] + at[hit]
            for (name, kind), value in zip(arrays, values, strict=True):
                value[a:b][hit] = packed(f"{self.folder}/{self.name}-{k}.{name}", kind).at(at[hit])
        return [x[back] for x in (ids, *values)]

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """The hashes of known ids."""
        out, order = np.zeros(len(ids), U64), np.argsort(ids)
        cuts = np.searchsorted(ids[order], self.first)
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
            at = order[cuts[k] : cuts[k + 1]]
            out[at] = mapped(f"{self.folder}/{self.name}-{k}.keys", "u8")[ids[at] - self.first[k]]
        return out


def named(order: int) -> str:
    return "word" if order == 1 else f"gram{order}"


def located(folder: str, name: str, sizes: list[int], starts: np.ndarray, ordered: np.ndarray) -> Iterator[tuple]:
    """(bucket, from, to, places) for the buckets that sorted hashes fall in; place -1: not there."""
    cuts = [*np.searchsorted(ordered, starts), len(ordered)]
    for k, size in enumerate(sizes):
        a, b = cuts[k], cuts[k + 1]
        if b > a and size:
            keys = mapped(f"{folder}/{name}-{k}.keys", "u8")
            at = np.searchsorted(keys, ordered[a:b])
            at[at == size] = 0
            yield k, a, b, np.where(keys[at] == ordered[a:b], at, -1)


def gram_hash(context: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """A bijective hash of the id of an n-gram's context and that of its last word, which has ``bits`` bits."""
    return mix64((context.astype(U64) << U64(bits)) | word.astype(U64))


def gram_parts(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``gram_hash``."""
    both = unmix64(hashes)
    return (both >> U64(bits)).astype(np.int64), (both & U64((1 << bits) - 1)).astype(np.int64)


def gram_hashes(context: np.ndarray, words: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams whose context and last word are known, and the places of these words; none reaches from one text to the next."""
    at = np.flatnonzero((context[:-1] >= 0) & (words[1:] >= 0) & (hashes[1:] != START)) + 1
    return gram_hash(context[at - 1], words[at], bits), at


def _grams(levels: list[Grams], bits: int, buckets: int):
    """Counts the n-grams one order above the last level."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter()
        for batch in batches:
            hashes = hashed(batch.column("raw").to_pylist())[0]
            words = ids = levels[0].find(hashes)[0]
            for level in levels[1:]:
                keys, at = gram_hashes(ids, words, hashes, bits)
                ids = np.full(len(hashes), -1, np.int64)
                ids[at] = level.find(keys)[0]
            own.add(gram_hashes(ids, words, hashes, bits)[0])
        yield from own.pieces(buckets)

    return count


def shortened(levels: list[Grams], context: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """Ids, at the last level, of the n-grams one order above it without their first word."""
    if len(levels) == 1:
        return word
    rest = shortened(levels[:-1], *gram_parts(levels[-1].keys(context), bits), bits)
    return levels[-1].find(gram_hash(rest, word, bits))[0]


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D for counts of 0, 1, 2 and 3 or more."""
    if not (n1 and n2):
        return [0.0, 0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [0.0] + [min(max(d, 0.1), k + 1 - 0.01) for k, d in enumerate(found)]


def _sides(levels: list[Grams], own: Grams, counts: str, cut: list[float], bits: int, held: int):
    """From each bucket of n-grams, in pieces by bucket of the order below: discount mass and total by context (side 0), different words before by the n-gram without its first word (side 1)."""
    below = levels[-1]

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("bucket").to_pylist():
                for start in range(0, own.sizes[k], held):
                    context, word = gram_parts(np.array(mapped(f"{own.folder}/{own.name}-{k}.keys", "u8")[start : start + held]), bits)
                    count = packed(f"{own.folder}/{own.name}-{k}.{counts}").part(start, start + held)
                    mass = np.asarray(cut)[np.minimum(count, U64(3)).astype(np.int64)]
                    fixed = np.rint(mass * 2**20).astype(U64)  # in fixed point, sums don't depend on order
                    for side, part, each in ((0, context, (fixed, count)), (1, shortened(levels, context, word, bits), (np.ones(len(word), U64),))):
                        order = np.argsort(part, kind="stable")
                        part = part[order]
                        at = np.flatnonzero(np.concatenate((np.ones(1, bool), part[1:] != part[:-1])))
                        gram, sums = part[at], [np.add.reduceat(x[order], at) for x in each]
                        cuts = np.searchsorted(gram, below.first)
                        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                            a, z = cuts[b], cuts[b + 1]
                            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "side": pa.array([side], pa.int32()), "keys": [squeezed(np.diff((gram[a:z] - below.first[b]).astype(U64), prepend=U64(0)))], "counts": [squeezed(np.concatenate([x[a:z] for x in sums]))]})

    return sides


def _gather(below: Grams):
    """Writes discount mass, total and adjusted counts of a bucket; returns how many n-grams have each small adjusted count."""

    def gather(key, table):
        bucket = key[0].as_py()
        path = f"{below.folder}/{below.name}-{bucket}"
        dense = [np.zeros(below.sizes[bucket], U64) for _ in range(3)]
        for side, keys, counts in zip(*(table.column(c).to_pylist() for c in ("side", "keys", "counts")), strict=True):
            at = np.cumsum(spread(keys), dtype=U64).astype(np.int64)
            for k, values in zip(((0, 2), (1,))[side], spread(counts).reshape(2 - side, -1), strict=True):
                dense[k][at] += values
        mass, adjusted, total = dense
        if below.name != named(1):  # no word stands before the start of a text: such n-grams keep their counts
            adjusted = np.where(adjusted > 0, adjusted, packed(f"{path}.counts").part(0, len(adjusted)))
        for name, values in (("mass", mass / 2**20), ("total", total), ("adjusted", adjusted)):
            write_packed(f"{path}.{name}", values)
        n = np.bincount(np.minimum(adjusted, U64(5)).astype(np.int64), minlength=6)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "size": [int((adjusted > 0).sum())], "total": [int(adjusted.sum())], **{f"n{i}": [int(n[i])] for i in range(1, 5)}})

    return gather


class Model:
    """Where the arrays are, and the few numbers that go with them; small, and sent to every task."""

    def __init__(self, levels, bits, tokens, types, cuts, low_cut, low_total, low_mass):
        self.levels, self.bits, self.tokens, self.types = levels, bits, tokens, types
        self.cuts, self.low_cut, self.low_total, self.low_mass = cuts, low_cut, low_total, low_mass

    def low(self, before: np.ndarray) -> np.ndarray:
        """q(w) from the numbers of different words before w."""
        uniform = 1 / (self.types + 1)
        if not self.low_total:
            return np.full(len(before), uniform)
        return (before - np.asarray(self.low_cut)[np.minimum(before, 3)]) / self.low_total + self.low_mass / self.low_total * uniform

    def scores(self, raw: list[bytes | None]) -> list[tuple[int, int, float, float]]:
        """n_tokens, n_known, base score and model score of each text."""
        if not raw:
            return []
        hashes, starts = hashed(raw)
        token = hashes != START
        context = (("mass", "f8"), ("total", "u8"))
        words, counts, before, mass, total = self.levels[0].find(hashes, ("counts", "u8"), ("adjusted", "u8"), *context)
        ids, counts, chance = words, counts.astype(np.float64), self.low(before.astype(np.int64))
        for level, cut in zip(self.levels[1:], self.cuts, strict=True):
            seen = np.flatnonzero((total[:-1] > 0) & token[1:]) + 1
            chance[seen] *= mass[seen - 1] / total[seen - 1]
            keys, at = gram_hashes(ids, words, hashes, self.bits)
            top = level is self.levels[-1]
            places, n, *rest = level.find(keys, ("counts" if top else "adjusted", "u8"), *(() if top else context))
            chance[at] += (n - np.asarray(cut)[np.minimum(n, U64(3)).astype(np.int64)]) / np.maximum(total[at - 1], U64(1))
            if not top:
                ids, mass, total = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes)), np.zeros(len(hashes), U64)
                ids[at], mass[at], total[at] = places, *rest
        with np.errstate(divide="ignore"):
            model = np.where(token, np.log10(chance), 0)
        base = np.where(token, np.log10((counts + ADD) / (self.tokens + ADD * (self.types + 1))), 0)
        sums = [np.add.reduceat(x, starts) for x in (token.astype(np.int64), (token & (counts > 0)).astype(np.int64), base, model)]
        return list(zip(*(s.tolist() for s in sums), strict=True))


def counted(tables: DataFrame, folder: str, order: int, buckets: int, tag: str) -> tuple[DataFrame, Grams, dict]:
    """Merges counted pieces of an order: a row a bucket, the arrays, and the rows by bucket."""
    rows = stash(tables.groupBy("bucket").applyInArrow(_merge(folder, named(order)), SIZES), tag)
    found = {r["bucket"]: r for r in rows.collect()}
    return rows, Grams(folder, order, [found[k]["size"] if k in found else 0 for k in range(buckets)]), found


def small_counts(rows) -> list[int]:
    return [sum(r[f"n{i}"] for r in rows) for i in range(1, 5)]


def trained(texts: DataFrame, order: int = 2) -> Model:
    """A model of the column ``raw`` (UTF-8 bytes) with ``order`` - 1 words of context."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = texts.sparkSession
    set_arrow_batches(spark)
    folder = shared_folder(spark, "lm")
    # Every task sends a piece to every bucket of words, so a bucket's input grows with the corpus: so does their number.
    size = texts.agg(F.sum(F.length("raw"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    _, words, rows = counted(texts.mapInArrow(_words(buckets), PIECES), folder, 1, buckets, "lm-words")
    documents = start_count(words)
    tokens, types = sum(r["total"] for r in rows.values()) - documents, sum(words.sizes) - (documents > 0)
    if sum(words.sizes) >= 2**32:
        raise ValueError("more than 2**32 different words")
    bits = max(1, sum(words.sizes).bit_length())
    if not documents:
        return Model([words], bits, 0, 0, [], discounts(0, 0, 0, 0), 0, 0.0)
    many = tokens // BUCKET_TOKENS + 1
    levels, tables = [words], []
    for n in range(2, order + 1):
        if sum(levels[-1].sizes) >= 2 ** (64 - bits):
            raise ValueError(f"more different n-grams of order {n - 1} than ids")
        table, level, rows = counted(texts.mapInArrow(_grams(levels[:], bits, many), PIECES), folder, n, many, f"lm-{named(n)}")
        levels.append(level)
        tables.append(table)
    cuts, rows = [], list(rows.values())
    for n in range(order, 1, -1):
        cuts.insert(0, discounts(*small_counts(rows)))
        below = levels[n - 2]
        dealt = tables[n - 2].select("bucket").repartition(many, "bucket")
        pieces = dealt.mapInArrow(_sides(levels[: n - 1], levels[n - 1], "counts" if n == order else "adjusted", cuts[0], bits, SLICE), SIDES)
        none = squeezed(np.zeros(0, U64))  # every bucket is written, even if no n-gram of this order touches it
        every = spark.createDataFrame([(k, 0, none, none) for k, size in enumerate(below.sizes) if size], SIDES)
        rows = stash(pieces.union(every).groupBy("bucket").applyInArrow(_gather(below), SIZES), f"lm-low-{n}").collect()
    n = small_counts(rows)
    low_cut, total = discounts(*n), sum(r["total"] for r in rows)
    three = sum(r["size"] for r in rows) - n[0] - n[1]
    low_mass = low_cut[1] * n[0] + low_cut[2] * n[1] + low_cut[3] * three
    return Model(levels, bits, tokens, types, cuts, low_cut, total, low_mass)


def start_count(words: Grams) -> int:
    """How many texts were counted: the count of START, which begins each."""
    return int(words.find(np.array([START], U64), ("counts", "u8"))[1][0])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = model.scores(batch.column("raw").to_pylist())
            n, known, base, own = zip(*rows, strict=True) if rows else [()] * 4
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model.tokens] * len(rows), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def scored(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of all texts by a model of those not held out."""
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(0))
    read = docs.select("doc_id", (remainder == 0).alias("held_out"), F.col("text").cast("binary").alias("raw"))
    model = trained(read.where(~F.col("held_out")).select("raw"), order)
    return read.mapInArrow(_scorer(model), SCORED)


def perplexity(scores: DataFrame) -> DataFrame:
    """Adds each text's perplexity to ``scored`` rows."""
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), ORDER)
