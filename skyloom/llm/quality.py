"""Quality rules: base figures of each text, and lines that too many documents of a host share.

A line's normal form is lower-cased (A-Z), has each run of digits replaced by 0 and runs of
white space by one space. Its frequency is the number of distinct documents (doc_id and text) of the host (column
``source``) that hold it. A line is removed if its frequency is above LEAST_DOCS, and above HOST_SHARE of the host's
documents or above MOST_DOCS, which no host is too large for; and if it stands in more than LEAST_DOCS different
texts, as a line that only copies of a few documents share is a matter of duplicates and not of the host. A document
is depleted, and rejected, if less than LEAST_LEFT percent of its words remain. Texts of any length are read whole; frequencies
at a limit are not above it.

Null or empty text: no words, so base_failed and not kept. Null source: a host of its own. Null doc_id: judged like any
other. A text is judged per source, so a repeated (doc_id, text) may stay under one and go under another.
Repeated rows get equal rows. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import join_small, set_arrow_batches, shingle_hashes, span_hashes, stash, word_spans

LEAST_DOCS = 10
HOST_SHARE = 0.01
MOST_DOCS = 1000
LEAST_LEFT = 30
MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8

_DIGITS = re.compile(rb"[0-9]+")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FIGURES = "doc_id long, source string, text_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:long>>"


def line_hash(line: bytes) -> tuple[int, int]:
    """Signed 64-bit hash of a line's normal form, and its number of words."""
    words = line.lower().split()
    if not words:
        return 0, 0
    return xxhash.xxh3_64_intdigest(_DIGITS.sub(b"0", b" ".join(words))) - (1 << 63), len(words)


def repeated_words(words: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    windows = shingle_hashes(words, WINDOW)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def figures(raw: bytes) -> tuple[int, int, int, int, int, list[dict]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the distinct lines of a text."""
    data = np.frombuffer(raw, np.uint8)
    start, end = word_spans(data)
    code_points = int(((data & 0xC0) != 0x80).sum())
    white = len(data) - int((end - start).sum())
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    again = 0
    for line in raw.split(b"\n"):
        h, w = line_hash(line)
        if not w:
            continue
        again += line in seen
        seen.add(line)
        lines[h] = lines.get(h, 0) + w
    return len(start), code_points - white, int(_SYMBOL[data].sum()), again, repeated_words(span_hashes(data, start, end)), [{"h": h, "w": w} for h, w in lines.items()]


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))
    for batch in batches:
        found = [figures(raw or b"") for raw in batch.column("raw").to_pylist()]
        columns = list(zip(*found, strict=True)) if found else [()] * 6
        arrays = [batch.column(c) for c in ("doc_id", "source", "text_id")]
        arrays += [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], kind)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "source", "text_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def text_figures(docs: DataFrame) -> DataFrame:
    """Base figures and line hashes of every text, written to the shared folder."""
    set_arrow_batches(docs.sparkSession)
    read = docs.select("doc_id", "source", F.xxhash64("text").alias("text_id"), F.col("text").cast("binary").alias("raw"))
    found = stash(read.mapInArrow(_figures, FIGURES), "quality")
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def frequent_lines(found: DataFrame) -> tuple[DataFrame, int]:
    """(source, h, docs): the lines above the limits, and their number."""
    document, text = F.struct("doc_id", "text_id"), F.col("text_id")
    # One row a line, text and document, then one a line and text: both counts from sums over rows that are combined before each shuffle.
    lines = found.select("source", "doc_id", "text_id", F.explode("lines.h").alias("h"))
    per_text = lines.groupBy("source", "h", "text_id").agg(F.countDistinct(document).alias("copies"))
    often = per_text.groupBy("source", "h").agg(F.sum("copies").alias("docs"), F.count(text).alias("texts")).where((F.col("docs") > LEAST_DOCS) & (F.col("texts") > LEAST_DOCS))
    hosts = found.groupBy("source").agg(F.countDistinct(document).alias("host_docs"))
    n_hosts = (hosts := stash(hosts, "quality-hosts")).count()
    above = join_small(often, hosts, ["source"], n_hosts, "inner").where((F.col("docs") > F.col("host_docs") * HOST_SHARE) | (F.col("docs") > MOST_DOCS))
    above = stash(above.select("source", "h", "docs"), "quality-lines")
    return above, above.count()


def judged(docs: DataFrame) -> DataFrame:
    """Base figures, removed lines and words, and the verdict ``kept`` for every document."""
    found = text_figures(docs)
    above, n = frequent_lines(found)
    lines = found.select("doc_id", "text_id", "source", F.explode("lines").alias("line")).select("doc_id", "text_id", "source", "line.h", "line.w")
    hits = join_small(lines, above.select("source", "h"), ["source", "h"], n, "inner").distinct()
    gone = hits.groupBy("doc_id", "text_id", "source").agg(F.sum("w").alias("removed_words"), F.collect_list("h").alias("removed_lines"))
    match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("doc_id", "text_id", "source")]
    both = found.drop("lines").alias("a").join(gone.alias("b"), match, "left").select("a.*", F.coalesce("b.removed_words", F.lit(0)).alias("removed_words"), "b.removed_lines")
    left = F.col("n_words") - F.col("removed_words")
    return both.withColumn("kept", ~F.col("base_failed") & (100 * left >= LEAST_LEFT * F.col("n_words")))


def without_lines(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines whose hash is listed; null lists leave null."""

    def clean(raw, hashes):
        if raw is None or hashes is None:
            return None
        bad = set(hashes)
        return "\n".join(x for x in raw.split("\n") if line_hash(x.encode())[0] not in bad)

    return pa.array([clean(t, g) for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True)], pa.string())


def quality_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, without the lines above the limits; n_chars follows the text where there is such a column."""
    keys = ["doc_id", "text_id", "source"]
    verdict = judged(docs).where("kept").select(*keys, "removed_lines").dropDuplicates(keys)
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.xxhash64("text").alias("__text_id"))
    own = {"doc_id": F.col("__row.doc_id"), "text_id": F.col("__text_id"), "source": F.col("__row.source")}
    kept = keyed.join(verdict, [own[k].eqNullSafe(F.col(k)) for k in keys])
    text = F.when(F.col("removed_lines").isNull(), F.col("__row.text")).otherwise(F.arrow_udf(without_lines, T.StringType())(F.when(F.col("removed_lines").isNotNull(), F.col("__row.text")), F.col("removed_lines")))
    cleaned = kept.withColumn("__text", text)
    new = {"text": F.col("__text"), "n_chars": F.when(F.col("removed_lines").isNull(), F.col("__row.n_chars")).otherwise(F.length("__text").cast("long"))} if "n_chars" in names else {"text": F.col("__text")}
    return cleaned.select(*[(new[c] if c in new else F.col("__row").getField(c)).alias(c) for c in names])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


_LOW = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, range(0, 8) AS t(j) GROUP BY 1),
line AS (SELECT *, regexp_extract_all({_LOW.format(x="line")}, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM w)),
l AS (SELECT doc_id, source, text, line, len(lw) AS n, regexp_replace(array_to_string(lw, ' '), '[0-9]+', '0', 'g') AS norm FROM line WHERE len(lw) > 0),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY 1),
often AS (SELECT source, norm, count(DISTINCT (doc_id, text)) AS docs FROM l GROUP BY 1, 2 HAVING count(DISTINCT (doc_id, text)) > {LEAST_DOCS} AND count(DISTINCT text) > {LEAST_DOCS}),
host AS (SELECT source, count(DISTINCT (doc_id, text)) AS host_docs FROM w GROUP BY 1),
above AS (SELECT o.source, norm FROM often o JOIN host h ON o.source IS NOT DISTINCT FROM h.source WHERE docs > host_docs * {HOST_SHARE} OR docs > {MOST_DOCS}),
gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM l JOIN above a ON l.norm = a.norm AND l.source IS NOT DISTINCT FROM a.source GROUP BY 1),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * (n_words - removed_words) >= {LEAST_LEFT} * n_words AS kept FROM b
"""
