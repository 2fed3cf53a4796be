"""Personal data: fixed patterns, and bootstrapped contextual extraction of identifiers they miss.

Fixed patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers. Those spans, and
long hexadecimal keys, are seed entities. Mentions are what may be an identifier: pieces between white space and separators that
hold a digit (neighbouring ones are one mention), and pieces that follow ``=`` or ``:``, with or without digits. Each mention is
described by lexical patterns (``patterns``): the words and separators before it, and those around it.
Spark holds the graph of patterns and instances and scores it in rounds until nothing changes: a pattern's confidence for a kind is the
sum of its known instances' scores over all its different instances, those of other kinds counted whole, unknown ones by MISS, and
one more as a miss; an instance's score is the noisy-or over its trusted patterns. Patterns with SUPPORT known instances and
confidence TRUST are trusted. Unknown mentions and keys whose instance reaches TRUST are added wherever they stand, as
``like_email`` and so on; ``secret`` is the kind of the keys. A key in no trusted pattern, such as a checksum in a
list, is left alone. Fixed spans always stay.

Null or empty text: no spans. Null doc_id: handled like any other. Very long texts: whole, in time linear in their length; of the
words of a pattern, what lies within CONTEXT characters of the mention counts. Ties between kinds: the later in the list of kinds.
Repeated rows get equal rows. Empty table: no rows. Other columns are not read, and pass through redaction.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import join_small, set_arrow_batches, stash

KINDS = ("email", "ip", "card", "phone")
FOUND = (*[f"like_{k}" for k in KINDS], "secret")
SUPPORT = 3
TRUST = 0.75
MISS = 0.5
#: Rounds end when nothing changes; trusted patterns only spread along the graph, so this is a guard.
ROUNDS = 20
SIZE = 6
CONTEXT = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits does, as digits before it would belong to it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SEPARATORS = "=|,;:\"'`()[]{}<>!?*#$&%"
_PIECE = re.compile(rf"[^\s{re.escape(_SEPARATORS)}]*")
_BREAK = frozenset(_SEPARATORS + " \t\n\r\x0b\x0c")
_SET = re.compile(r"[=:][\x20\t]{0,2}[\"'`(\[<]?(?=[^\W\d_])")
_LEXEME = re.compile(rf"[^\s{re.escape(_SEPARATORS)}]+|[{re.escape(_SEPARATORS)}]")
_KEY = re.compile(r"(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with a domain after it and a run of local characters before it; linear in the text."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if found and start < at:
            out.append((start, found.end()))
            floor = found.end()
        at = text.find("@", max(floor, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def written(spans, names=KINDS) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)


def _lexemes(text: str) -> list[str]:
    """Words and separators, digits as 0, in lower case."""
    return [_DIGIT.sub("0", w).lower() for w in _LEXEME.findall(text)]


def patterns(text: str, start: int, end: int) -> set[str]:
    """The lexical patterns of a mention: two words before it with the separators after them; one word, if separators follow; one word and what follows the mention."""
    before = _lexemes(text[max(0, start - CONTEXT) : start])
    after = _lexemes(text[end : end + CONTEXT])[:1]
    words = [k for k, w in enumerate(before) if w not in _BREAK]
    if not words:
        return set()
    one, two = " ".join(before[words[-1] :]), " ".join(before[words[-2] :]) if len(words) > 1 else ""
    return {p for p in (f"L {two}" * bool(two), f"S {one}" * (words[-1] < len(before) - 1), f"B {one} _ {' '.join(after)}") if p}


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of seeds and of what may be an identifier; kind -1: unknown, 4: a key."""
    taken = sorted((a, b) for _, a, b in base)
    out, at, k = [], 0, 0
    while found := _DIGIT.search(text, at):
        start = found.start()
        while start > at and text[start - 1] not in _BREAK:
            start -= 1
        end = _PIECE.match(text, found.start()).end()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            at = max(end, taken[k][1])
            continue
        key = _KEY.fullmatch(text, start, end)
        limit = taken[k][0] if k < len(taken) else len(text)
        while not key and end < limit - 1 and text[end] in " -" and (more := _PIECE.match(text, end + 1)).end() <= limit and _DIGIT.search(more[0]) and not _KEY.fullmatch(more[0]):
            end = more.end()
        at = end
        while end > start and text[end - 1] in ".-/":
            end -= 1
        if end - start >= SIZE:
            out.append((4 if key else -1, start, end))
    for found in _SET.finditer(text):
        start, end = found.end(), _PIECE.match(text, found.end()).end()
        while end > start and text[end - 1] in ".-/":
            end -= 1
        if end - start >= SIZE and not _DIGIT.search(text, start, end):
            out.append((-1, start, end))
    return [*base, *_apart(out, taken)]


def _apart(spans: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap none of the sorted ``taken``."""
    out, k = [], 0
    for span in sorted(spans, key=lambda s: s[1]):
        while k < len(taken) and taken[k][1] <= span[1]:
            k += 1
        if k == len(taken) or taken[k][0] >= span[2]:
            out.append(span)
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


SCANNED = "doc_id long, text_id long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, mentions array<struct<kind:int,start:int,end:int,instance:long,patterns:array<long>>>"
_MENTIONS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, bases, shas, found = [[] for _ in KINDS], [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            for kind, column in enumerate(counts):
                column.append(sum(s[0] == kind for s in base))
            bases.append(written(base))
            shas.append(hashlib.sha256(bases[-1].encode()).hexdigest())
            rows = []
            for kind, a, b in mentions(text, base):
                rows.append({"kind": kind, "start": a, "end": b, "instance": _hash(text[a:b].lower()), "patterns": [_hash(p) for p in patterns(text, a, b)]})
            found.append(rows)
        arrays = [batch.column("doc_id"), batch.column("text_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(bases, pa.string()), pa.array(shas, pa.string()), pa.array(found, _MENTIONS)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_id", *[f"n_{k}" for k in KINDS], "base", "base_sha256", "mentions"])


def scanned(docs: DataFrame) -> DataFrame:
    """Fixed spans and mentions of every text, in the shared folder."""
    set_arrow_batches(docs.sparkSession)
    return stash(docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text").mapInArrow(_scan, SCANNED), "pii")


def trusted_patterns(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, trust) of the patterns that hold after the last round, and (instance, kind) of the instances they name."""
    all_edges = found.select(F.explode("mentions").alias("m")).select("m.instance", "m.kind", F.explode("m.patterns").alias("pattern"))
    # Mentions of an instance agree on its kind: the fixed one if there is any.
    edges = all_edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    edges, sizes = stash(edges, "pii-edges"), stash(sizes, "pii-sizes")
    edges = stash(edges.join(sizes, "pattern"), "pii-graph")
    seeds = edges.where("kind >= 0").select("pattern", "instance", "n", "kind", F.lit(1.0).alias("score"))
    unknown = edges.where("kind < 0").select("pattern", "instance", "n")
    known, before = seeds, None
    for _ in range(ROUNDS):
        sums = known.groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("named"), F.first("n").alias("n"))
        every = known.groupBy("pattern").agg(F.sum("score").alias("all"), F.countDistinct("instance").alias("known"))
        rated = sums.where(F.col("named") >= SUPPORT).join(every, "pattern")
        trust = F.col("score") / (F.col("all") + MISS * (F.col("n") - F.col("known")) + 1)
        best = rated.withColumn("trust", F.round(trust, 9)).where(F.col("trust") >= TRUST).groupBy("pattern").agg(F.max(F.struct("trust", "kind")).alias("b"))
        trusted = stash(best.select("pattern", F.col("b.kind").alias("kind"), F.col("b.trust").alias("trust")), "pii-trusted")
        state = trusted.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("pattern", "kind", "trust").cast("decimal(38,0)")).alias("h")).first()
        hits = join_small(unknown, trusted, ["pattern"], state["n"], "inner")
        # One minus the product of the chances to be wrong; trust is below 1, so the logarithm is finite.
        scores = hits.groupBy("instance", "kind").agg(F.round(1 - F.exp(F.sum(F.log1p(-F.col("trust")))), 9).alias("score"))
        scores = stash(scores.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", F.col("b.kind").alias("kind"), F.col("b.score").alias("score")), "pii-scores")
        if not state["n"] or before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
        known = seeds.unionByName(unknown.join(scores, "instance").select("pattern", "instance", "n", "kind", "score"))
    keys = join_small(edges.where("kind = 4").select("pattern", "instance"), trusted.where("kind = 4"), ["pattern"], state["n"], "inner")
    named = scores.where(F.col("score") >= TRUST).select("instance", "kind").unionByName(keys.select("instance", "kind").distinct())
    return trusted, stash(named, "pii-named")


def spotted(docs: DataFrame) -> DataFrame:
    """Counts, base spans, their digest and the added spans of every document."""
    found = scanned(docs)
    named = trusted_patterns(found)[1].withColumnRenamed("kind", "as")
    open_ = found.select("doc_id", "text_id", F.explode("mentions").alias("m")).select("doc_id", "text_id", "m.kind", "m.start", "m.end", "m.instance").where("kind < 0 or kind = 4")
    new = join_small(open_, named, ["instance"], named.count(), "inner").select("doc_id", "text_id", F.col("as").alias("kind"), "start", "end")
    added = new.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    match = [F.col(f"f.{k}").eqNullSafe(F.col(f"x.{k}")) for k in ("doc_id", "text_id")]
    both = found.drop("mentions").alias("f").join(added.alias("x"), match, "left").select("f.*", "x.added")
    names = F.array(*[F.lit(k) for k in FOUND])
    extra = F.concat_ws(",", F.transform("added", lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))
    spans = F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), F.nullif(extra, F.lit("")))
    total = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.greatest(F.size("added"), F.lit(0))
    return both.withColumn("spans", spans).withColumn("n_spans", total.cast("long")).drop("added", "base")


def redacted(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first, then longest, counts."""
    cuts = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",")))
    parts, at = [], 0
    for start, end, kind in cuts:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
            at = -end
        elif -end > at:
            at = -end
    return "".join(parts) + text[at:]


def _redact(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([redacted(t, s) if t is not None and s else None for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def redacted_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; n_chars follows the text where there is such a column."""
    spans = stash(spotted(docs).where("spans <> ''").select(F.col("doc_id").alias("__doc_id"), F.col("text_id").alias("__text_id"), "spans").distinct(), "pii-spans")
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.xxhash64("text").alias("__text_id"))
    both = join_small(keyed.withColumn("__doc_id", F.col("__row.doc_id")), spans, ["__doc_id", "__text_id"], spans.count())
    clean = F.arrow_udf(_redact, T.StringType())(F.when(F.col("spans").isNotNull(), F.col("__row.text")), F.col("spans"))
    both = both.withColumn("__text", F.when(F.col("spans").isNull(), F.col("__row.text")).otherwise(clean))
    new = {"text": F.col("__text"), "n_chars": F.when(F.col("spans").isNull(), F.col("__row.n_chars")).otherwise(F.length("__text").cast("long"))} if "n_chars" in names else {"text": F.col("__text")}
    return both.select(*[(new[c] if c in new else F.col("__row").getField(c)).alias(c) for c in names])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spotted(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")
