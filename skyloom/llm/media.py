"""Media columns: payloads in tar shards, addressed by their content.

A table row holds a payload's digest and where its stored form lies: shard, offset and length.
The stored form is an 8-bit grey PNG of width 64, so a payload is bytes padded with 0 to a positive multiple of
64; the member's name in the tar shard is the payload's SHA-256. A task stores each payload once; equal payloads
that other tasks store have equal bytes, and ``canonical`` gives one place for each digest.

Metadata columns are filled by reading only the first HEADER_BYTES of a member; payloads are read whole, one at a
time, to check the stored form and compute features. Shards lie in the shared folder, so lost executors lose nothing.

Null or empty text: 64 bytes of 0. Null doc_id: kept. Repeated rows share a place within a task. Payloads of any length are one member
each, in memory one at a time. Nothing is ranked, so there are no ties. Empty table: no shards, no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import file_system, set_arrow_batches, shared_folder, stash

WIDTH = 64
LEVEL = 1
SHARD_BYTES = 256 << 20
BLOCK = 512
#: Bytes of a shard that are read back together, and of all shards for one task.
SPAN_BYTES = 4 << 20
READ_BYTES = 32 << 20
#: Fixed values of the format: its signature, and the length of all before the first data chunk.
PNG = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
PLACES = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
HEADERS = "width int, height long, bit_depth int, colour int"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height long, bit_depth int"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encoded(payload: bytes) -> bytes:
    """A payload as a PNG: each row of WIDTH samples after a filter byte of 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.zeros((len(rows), WIDTH + 1), np.uint8)
    plain[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(start: bytes) -> dict:
    """Metadata from the first HEADER_BYTES of a stored form."""
    if start[:8] != PNG or start[12:16] != b"IHDR" or zlib.crc32(start[12:29]) != int.from_bytes(start[29:33], "big"):
        raise ValueError("not the header of a PNG")
    width, height, depth, colour = struct.unpack(">IIBB", start[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour": colour}


def decoded(media: bytes) -> bytes:
    """The payload of a stored form; chunk checksums are verified."""
    size, at, data = header(media[:HEADER_BYTES]), 8, []
    while at < len(media):
        n = int.from_bytes(media[at : at + 4], "big")
        body = media[at + 4 : at + 8 + n]
        if zlib.crc32(body) != int.from_bytes(media[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("a chunk does not fit its checksum")
        if body[:4] == b"IDAT":
            data.append(body[4:])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size["height"], size["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("only filter 0 is written")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, standard deviation and 8-bin histogram of the samples, in fixed digits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    values = np.arange(256)
    n = int(counts.sum())
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    mean = total / n
    bins = counts.reshape(8, 32).sum(axis=1)
    return f"{mean:.4f} {max(0.0, squares / n - mean * mean) ** 0.5:.4f} " + ",".join(str(int(b)) for b in bins)


class Shard:
    """A tar file under way in the shared folder."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/part-{uuid.uuid4().hex}.tar"
        system, path = file_system(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.at = 0
        self.places: dict[bytes, tuple[str, int, int]] = {}

    def add(self, payload: bytes) -> tuple[str, int, int]:
        """Digest, offset and length of a payload's stored form, written unless it is there."""
        key = hashlib.sha256(payload).digest()
        if key not in self.places:
            media = encoded(payload)
            info = tarfile.TarInfo(f"{key.hex()}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT if info.size < 8 << 30 else tarfile.GNU_FORMAT)
            self.out.write(head + media + bytes(-len(media) % BLOCK))
            self.places[key] = (key.hex(), self.at + len(head), len(media))
            self.at += len(head) + len(media) + -len(media) % BLOCK
        return self.places[key]

    def close(self) -> None:
        self.out.write(bytes(2 * BLOCK))
        self.out.close()


def _storer(folder: str):
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                if shard is None or shard.at >= SHARD_BYTES:
                    if shard:
                        shard.close()
                    shard = Shard(folder)
                rows.append((doc_id, len(raw or b""), shard.uri, *shard.add(padded(raw or b""))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            ids, n, shards, digests, offsets, lengths = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([ids, n, digests, shards, offsets, lengths], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    return store


def stored(docs: DataFrame, folder: str) -> DataFrame:
    """Write every text's payload to tar shards below ``folder``; a row a document with digest, shard, offset and length."""
    set_arrow_batches(docs.sparkSession)
    read = docs.select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return stash(read.mapInArrow(_storer(folder), PLACES), "media")


def canonical(places: DataFrame) -> DataFrame:
    """One place for each digest."""
    return places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")


class Reader:
    """Range reads of shards; holds one open file, and the results of places already seen in it."""

    def __init__(self):
        self.uri, self.file, self.seen = None, None, {}

    def at(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            system, path = file_system(uri)
            self.uri, self.file, self.seen = uri, system.open_input_file(path), {}
        self.file.seek(offset)
        found = self.file.read(length)
        if len(found) != length:
            raise ValueError(f"{uri} ends within a member")
        return found


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    names = ("width", "height", "bit_depth", "colour")
    for batch in batches:
        rows = batch.select(["shard", "offset"]).to_pylist()
        found = [header(reader.at(r["shard"], r["offset"], HEADER_BYTES)) for r in rows]
        arrays = [pa.array([f[c] for f in found], pa.int64() if c == "height" else pa.int32()) for c in names]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])


def with_headers(places: DataFrame) -> DataFrame:
    """Adds width, height, bit depth and colour type by range reads of the members' headers."""
    return places.mapInArrow(_headers, f"{PLACES}, {HEADERS}")


def described(media: bytes, digest: str) -> tuple:
    """What is computed from a stored form."""
    payload = decoded(media)
    sha = hashlib.sha256(payload).hexdigest()
    if sha != digest:
        raise ValueError("a payload does not fit its digest")
    return len(payload), sha, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            key = (r["shard"], r["offset"])
            if key not in reader.seen:
                media = reader.at(r["shard"], r["offset"], r["length"])
                reader.seen[key] = described(media, r["digest"])
            found.append(reader.seen[key])
        columns = list(zip(*found, strict=True)) if found else [()] * len(names)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        kept = ["width", "height", "bit_depth"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays, *[batch.column(c) for c in kept]], names=["doc_id", "n_bytes", *names, *kept])


def dealt(places: DataFrame) -> DataFrame:
    """Places by spans of their shards, in file order. The table is small against the shards, so it is dealt by bytes to read, not by its own size."""
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, total // READ_BYTES)
    return places.repartition(tasks, "shard", F.floor(F.col("offset") / SPAN_BYTES)).sortWithinPartitions("shard", "offset")


def features(places: DataFrame) -> DataFrame:
    """Reads each stored payload back; equal payloads of a shard are read once."""
    return with_headers(dealt(places)).mapInArrow(_features, FEATURES)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return features(stored(docs, shared_folder(spark, "media-shards")))
