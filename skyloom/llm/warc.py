"""WARC archives in Zstandard: one frame a record, a dictionary in the leading skippable frame.

Writing: each task writes archives of its own to the shared folder. The dictionary is trained on the
task's first payloads (at most SAMPLE_BYTES) and stored, itself compressed, in a skippable frame at the
archive's start. Of records with equal payloads (by SHA-1 and length) of at least ``least`` bytes, that with the smallest id is
a response, and the others are revisits that refer to it; smaller payloads are always responses.

Reading: archives are dealt to tasks whole; a task loads the dictionary, decodes one frame after another and checks
version, needed headers, Content-Length, block and payload digests. Pages never pass through the driver.

Null payload: an empty one. Null id: written with an empty id, never refers to or is referred to by id.
Repeated ids: each row is a record, revisiting by its own payload; of equal payloads, all rows of the smallest id (ties) are responses.
Very long payloads: a record each, held whole by the one task at work on it. Empty table: no archives, no records. Other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import file_system, join_small, set_arrow_batches, shared_folder, stash

#: Fixed values of the two formats.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 256 << 20
LEAST_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"
ARCHIVES = "archive string, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of a SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, refers_url=None) -> bytes:
    """One WARC record: a response with its HTTP block, or a revisit without payload."""
    named = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    ident = "" if page_id is None else page_id
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{ident}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"X-Page-ID: {ident}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{named}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean(url: str | None) -> str:
    """A header value can't hold line ends."""
    return "".join(c for c in url or "" if c not in "\r\n")


def trained(samples: list[bytes]) -> bytes:
    """A dictionary, or none where the samples are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 20 else b""
    except zstandard.ZstdError:
        return b""


class Archive:
    """An archive under way in the shared folder."""

    def __init__(self, folder: str, dictionary: bytes):
        self.path = f"{folder}/part-{uuid.uuid4().hex}.warc.zst"
        system, path = file_system(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        kept = zstandard.ZstdCompressor(level=3).compress(dictionary) if dictionary else b""
        self.out.write(DICTIONARY_MAGIC + len(kept).to_bytes(4, "little") + kept)
        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.press = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **given)
        self.bytes = self.records = 0

    def add(self, raw: bytes) -> None:
        frame = self.press.compress(raw)
        self.out.write(frame)
        self.bytes += len(frame)
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return {"archive": self.path, "records": self.records}


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            if archive is None or archive.bytes >= ARCHIVE_BYTES:
                if archive:
                    done.append(archive.close())
                samples, total = [], 0
                for r in rows:
                    if total < SAMPLE_BYTES and r["payload"]:
                        samples.append(r["payload"][:65536])
                        total += len(samples[-1])
                archive = Archive(folder, trained(samples))
            for r in rows:
                archive.add(record(r["page_id"], r["url"], r["payload"] or b"", r["refers_to"]))
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    return write


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, sha, n, refers_to) of the pages that only refer to another, from page_id, sha and n."""
    sized = stash(pages.where("page_id is not null").select("page_id", "sha", "n").where(F.col("n") >= least), "warc-digests")
    copied = stash(sized.groupBy("sha", "n").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "warc-copied")
    # One payload, such as the empty one, may be that of a large share of all pages.
    found = join_small(sized, copied, ["sha", "n"], copied.count(), "inner")
    return stash(found.where("page_id <> refers_to").select("page_id", "sha", "n", "refers_to").distinct(), "warc-revisits")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write (page_id, url, html) as archives below ``folder``; (archive, records) a file, from the shared folder."""
    set_arrow_batches(pages.sparkSession)
    payload = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    read = payload.select("*", F.sha1("payload").alias("sha"), F.length("payload").cast("long").alias("n"))
    joined = read.join(revisits(read, least), ["page_id", "sha", "n"], "left").select("page_id", "url", "payload", "refers_to")
    return stash(joined.mapInArrow(_writer(folder), ARCHIVES), "warc-archives")


class Damaged(ValueError):
    """An archive that doesn't keep to its format."""


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decoded records of an archive, one a frame, holding one frame at a time."""
    start = stream.read(8)
    given = {}
    held = start
    if start[:4] == DICTIONARY_MAGIC:
        size = int.from_bytes(start[4:8], "little")
        kept = stream.read(size)
        if len(kept) != size:
            raise Damaged("the dictionary frame is cut short")
        if kept[:4] == FRAME_MAGIC:
            kept = zstandard.ZstdDecompressor().decompress(kept)
        if kept:
            given = {"dict_data": zstandard.ZstdCompressionDict(kept)}
        held = b""
    whole = zstandard.ZstdDecompressor(**given)
    while True:
        held = held or stream.read(chunk)
        if not held:
            return
        frame, parts = whole.decompressobj(), []
        while True:
            parts.append(frame.decompress(held))
            if frame.eof:
                held = frame.unused_data
                break
            held = stream.read(chunk)
            if not held:
                raise Damaged("the last frame is cut short")
        yield b"".join(parts)


NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (VERSION, b"WARC/1.0"):
        raise Damaged(f"not a WARC record: {lines[0][:20]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise Damaged(f"not a header: {line[:40]!r}")
        headers[name.strip()] = value.strip()
    if missing := [x for x in NEEDED if x not in headers]:
        raise Damaged(f"headers missing: {missing}")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Damaged(f"Content-Length {size}, but {len(rest) - 4} bytes follow")
    block = rest[:size]
    if (said := headers.get("WARC-Block-Digest")) and said != f"sha1:{digest(block)}":
        raise Damaged("the block does not fit its digest")
    return headers, block


def described(raw: bytes) -> dict:
    """The row of a record; a response's length and digest are those of the payload read, checked against the headers."""
    headers, block = parsed(raw)
    kind = headers["WARC-Type"]
    said, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (len(payload), digest(payload)) != (size, said):
            raise Damaged("the payload does not fit its digest or length")
    ident, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
    return {"page_id": int(ident) if ident else None, "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": int(refers) if refers else None}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            system, path = file_system(row["archive"])
            found, count = [], 0
            with system.open_input_stream(path) as stream:
                for raw in frames(stream):
                    found.append(described(raw))
                    count += 1
                    if len(found) >= 4096:
                        yield pa.RecordBatch.from_pylist(found, schema=shape)
                        found = []
            if count != row["records"]:
                raise Damaged(f"{row['archive']} has {count} records, not {row['records']}")
            yield pa.RecordBatch.from_pylist(found, schema=shape)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row a record of the archives named by ``archives`` (archive, records)."""
    spark = archives.sparkSession
    dealt = archives.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive")
    return dealt.mapInArrow(_read, RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, shared_folder(spark, "warc")))


SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS sha FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(sha, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4)))::INTEGER % 32, 1), '' ORDER BY i)
     FROM range(32) AS r(i)) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
