"""Alignment of two tokenizers on the same bytes, and how many documents link each pair of ids.

Each text is encoded by both, with a leading space. Byte offsets where tokens of both end cut it into groups; two tokens are
linked where their byte ranges overlap. As both cover the same bytes without gaps, every piece between neighbouring ends
(of either) lies in one token of each, and no two pieces have the same two tokens: the links are these pieces.

1. Ids of both are kept in the shared folder, two bytes each where the vocabularies allow it; links follow from them.
2. A pair is one 64-bit key, A's id in the upper half. Each task counts its documents' distinct keys with np.unique and merges
   these counts; it emits what it has when more than HELD keys are held.
3. Partial counts are sorted by ranges of the key over the whole corpus; a task sums runs of equal keys as they pass and writes
   them as a shard: an array of sorted keys and one of counts. A key has at most a few rows a task, so no key is hot.
4. Workers memory-map the shards and look up a batch's distinct keys with searchsorted. The highest count of each id of A is
   an array as long as A's vocabulary. The shards are at most as long as the product of both vocabularies, whatever the corpus.

Null or empty text, or one that the joined bytes of either don't give back: no tokens, zeros. Null doc_id: like any other.
Repeated rows count as a document each. Texts of any length are encoded whole, one at a time. Ties for the highest count are all best.
Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import set_arrow_batches, shared_folder, stash
from skyloom.llm.packing import encoder, vocabulary_path
from skyloom.llm.shards import Writer, mapped

#: Keys a task holds before it merges or emits them.
HELD = 1 << 21
ENCODED = "doc_id long, a binary, b binary, n_groups long, n_links long, groups_sha256 string"
SHARD = "uri string, first long, size long, ids binary, most binary"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, vocabulary: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        letters = byte_letters()
        known = Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.encode_a = encoder(vocabulary)
        model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.encode_b = lambda text: model.encode(text, num_threads=1)
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(len(model)) for p in (model.id_to_piece(i),)]
        self.length_a, self.length_b = (np.array([len(x) for x in known], np.int64) for known in (self.bytes_a, self.bytes_b))
        # An id's digits and what follows it: within a group, or at the end of A's or B's part of one.
        self.digits = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]
        self.kind_a, self.kind_b = ("<u2" if len(known) <= 1 << 16 else "<u4" for known in (self.bytes_a, self.bytes_b))

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        whole = " " + text
        raw = whole.encode("utf-8", "surrogatepass")
        a, b = self.encode_a(whole), self.encode_b(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return none, none
        return np.array(a, np.int64), np.array(b, np.int64)

    def stored(self, a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
        return a.astype(self.kind_a).tobytes(), b.astype(self.kind_b).tobytes()

    def ids(self, a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(a, self.kind_a).astype(np.int64), np.frombuffer(b, self.kind_b).astype(np.int64)

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte offset, whether a token of A, and one of B, ends there."""
        at_a, at_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        marks = np.zeros((2, at_a[-1] + 1 if len(a) else 1), np.int8)
        marks[0, at_a] = marks[1, at_b] = 1
        return marks[0], marks[1]

    def links(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The key of every link, in order of the bytes."""
        in_a, in_b = self.ends(a, b)
        end = np.flatnonzero(in_a | in_b)
        nth_a, nth_b = (np.cumsum(x, dtype=np.int64)[end] - x[end] for x in (in_a, in_b))
        return (a[nth_a] << 32) | b[nth_b]

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[int, str]:
        """Number of groups, and their ids as text."""
        if not len(a):
            return 0, ""
        in_a, in_b = self.ends(a, b)
        both = in_a & in_b
        before = np.cumsum(both, dtype=np.int64) - both
        of_a, of_b = before[np.flatnonzero(in_a)], before[np.flatnonzero(in_b)]
        last_a, last_b = (np.append(of[1:] != of[:-1], True) for of in (of_a, of_b))
        order = np.argsort(np.concatenate((2 * of_a, 2 * of_b + 1)), kind="stable")
        place = np.concatenate((2 * a + last_a, 2 * (len(self.bytes_a) + b) + last_b))[order]
        return int(before[-1]) + 1, "".join(map(self.digits.__getitem__, place.tolist()))[:-1]


@cache
def pair(vocabulary: str, pieces: str) -> Pair:
    return Pair(vocabulary, pieces)


def _encode(vocabulary: str, pieces: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(vocabulary, pieces)
        for batch in batches:
            held_a, held_b, groups, links, digests = [], [], [], [], []
            for text in batch.column("text"):
                a, b = both.encode(text.as_py())
                n, written = both.groups(a, b)
                for held, ids in zip((held_a, held_b), both.stored(a, b), strict=True):
                    held.append(ids)
                groups.append(n)
                links.append(len(a) + len(b) - n)
                digests.append(hashlib.sha256(written.encode()).hexdigest() if len(a) else "")
            arrays = [pa.array(held_a, pa.binary()), pa.array(held_b, pa.binary()), pa.array(groups, pa.int64()), pa.array(links, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "a", "b", "n_groups", "n_links", "groups_sha256"])

    return encode


def encoded(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """Ids of both tokenizers and the groups of every document, in the shared folder."""
    set_arrow_batches(docs.sparkSession, 256)
    return stash(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(vocabulary or vocabulary_path(), pieces or piece_path()), ENCODED), "align")


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _counted(key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(key), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 16)]), pa.array(count[a : a + (1 << 16)])], names=["key", "n"])


def _count(vocabulary: str, pieces: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(vocabulary, pieces)
        keys, counts, held = [], [], 0
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                own = np.unique(both.links(*both.ids(a.as_py(), b.as_py())))
                keys.append(own)
                counts.append(np.ones(len(own), np.int64))
                held += len(own)
                if held > HELD:
                    key, n = merged(keys, counts)
                    keys, counts, held = [key], [n], len(key)
                    if held > HELD // 2:
                        yield from _counted(key, n)
                        keys, counts, held = [], [], 0
        if keys:
            yield from _counted(*merged(keys, counts))

    return count


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums runs of equal keys, which are in order, into a shard; the last run is held until the next key is seen."""
        from pyspark import TaskContext

        out, first, size = None, 0, 0
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, most = [], []
        uri = f"{folder}/{TaskContext.get().partitionId()}"

        def put(done: int):
            nonlocal size
            for writer, values in zip(out, (key[:done], count[:done]), strict=True):
                writer.write(values)
            size += done
            word = key[:done] >> 32
            at = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if done else np.zeros(0, np.int64)
            if len(at):
                ids.append(word[at])
                most.append(np.maximum.reduceat(count[:done], at))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, count = merged([key, batch.column("key").to_numpy()], [count, batch.column("n").to_numpy()])
            if out is None:
                out, first = (Writer(f"{uri}.keys"), Writer(f"{uri}.counts")), int(key[0])
            put(len(key) - 1)
            key, count = key[-1:], count[-1:]
        if out:
            put(1)
            for writer in out:
                writer.close()
            tops = [np.concatenate(x).astype("<i8").tobytes() for x in (ids, most)]
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([first]), pa.array([size]), pa.array([tops[0]], pa.binary()), pa.array([tops[1]], pa.binary())], names=["uri", "first", "size", "ids", "most"])

    return write


class Counts:
    """Shards of sorted keys with their counts, and the highest count of each id of A."""

    def __init__(self, shards: list[tuple[int, str]], most: np.ndarray):
        self.shards, self.most = sorted(shards), most
        self.first = np.array([first for first, _ in self.shards], np.int64)

    def find(self, ordered: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, all of which are in the shards."""
        out, cuts = np.zeros(len(ordered), np.int64), [*np.searchsorted(ordered, self.first), len(ordered)]
        for (_, uri), a, b in zip(self.shards, cuts, cuts[1:], strict=False):
            if b > a:
                out[a:b] = mapped(f"{uri}.counts", "<i8")[np.searchsorted(mapped(f"{uri}.keys", "<i8"), ordered[a:b])]
        return out


def pair_counts(found: DataFrame, vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """(key, n): partial counts of documents that link a pair, summed over the whole corpus by ``counts``."""
    return found.select("a", "b").mapInArrow(_count(vocabulary or vocabulary_path(), pieces or piece_path()), "key long, n long")


def counts(found: DataFrame, vocabulary: str | None = None, pieces: str | None = None) -> Counts:
    """Shards of all pairs' counts in the shared folder. The driver gets a row a shard and numbers by id of A, as many as its vocabulary has."""
    spark = found.sparkSession
    # Written first: the choice of ranges reads the rows once more than the sort does.
    partial = stash(pair_counts(found, vocabulary, pieces), "align-pairs").repartitionByRange("key").sortWithinPartitions("key")
    rows = stash(partial.mapInArrow(_write(shared_folder(spark, "align-shards")), SHARD), "align-index").collect()
    most = np.zeros(len(pair(vocabulary or vocabulary_path(), pieces or piece_path()).bytes_a), np.int64)
    for r in rows:
        np.maximum.at(most, np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["most"], "<i8"))
    return Counts([(r["first"], r["uri"]) for r in rows], most)


def _look_up(vocabulary: str, pieces: str, shared):
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, known = pair(vocabulary, pieces), shared.value
        for batch in batches:
            n_a, n_b, own = [], [], []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = both.ids(a.as_py(), b.as_py())
                n_a.append(len(a))
                n_b.append(len(b))
                own.append(np.unique(both.links(a, b), return_counts=True))
            key = np.concatenate([k for k, _ in own]) if own else np.zeros(0, np.int64)
            distinct, back = np.unique(key, return_inverse=True)
            count = known.find(distinct)[back]
            times = np.concatenate([t for _, t in own]) if own else key
            best = np.append(0, np.cumsum(times * (count == known.most[key >> 32])))
            total = np.append(0, np.cumsum(times * count))
            edge = np.cumsum([0, *[len(k) for k, _ in own]])
            sums = [x[edge[1:]] - x[edge[:-1]] for x in (best, total)]
            arrays = [batch.column("doc_id"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), batch.column("n_groups"), batch.column("n_links"), *[pa.array(x, pa.int64()) for x in sums], batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return look_up


def aligned(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """Tokens, groups and links of every document, and how common its links are in the corpus."""
    vocabulary, pieces = vocabulary or vocabulary_path(), pieces or piece_path()
    found = encoded(docs, vocabulary, pieces)
    shared = docs.sparkSession.sparkContext.broadcast(counts(found, vocabulary, pieces))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return found.mapInArrow(_look_up(vocabulary, pieces, shared), schema)


def alignment(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """(a_id, b_id, n_docs): the pairs that some document links, and how many do."""
    total = pair_counts(encoded(docs, vocabulary, pieces), vocabulary, pieces).groupBy("key").agg(F.sum("n").alias("n_docs"))
    return total.select(F.shiftright("key", 32).cast("int").alias("a_id"), F.col("key").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("b_id"), "n_docs")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
