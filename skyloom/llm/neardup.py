"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct runs of five lower-cased (A-Z) words, as 64-bit hashes; with fewer words, the
whole sequence as one. A first permutation (a bijective mix) deals the hashes to positions of a
circle; a second one, shifted by k places, gives coordinate k of the signature. Bands of four
coordinates name buckets; 25 bands miss a pair of similarity 0.75 with a probability under 1e-4.

Documents of equal sets are one class from the start. In each bucket, the member with most bucket neighbours is
compared with all others, which joins most groups of copies at a comparison a member. Buckets whose members are then still in
different components go through an exact prefix filter: two sets of different components can be alike only if they
share a shingle among the rarest of both, at places that leave enough others (``postings``). What passes is compared in blocks of
bounded size: a task counts the common shingles of all pairs of two blocks as a product of incidence matrices and returns at
most a forest of links. So no pair of a bucket is left out, and none is ever a row. Links hold where
100 * common >= 75 * all, on full sets.

Null, empty or blank text: an empty set, linked with nothing. Null doc_id: never linked, null
component, kept. Repeated rows are copies of each other and get equal rows. One doc_id with several texts is one node, linked
where any of its texts is; its kept row is that of the text with the least hash. Very long texts: whole, their signature in pieces.
Ties do not occur: a component's name is its least doc_id. Empty table: no rows. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import U64, join_small, mix64, set_arrow_batches, shingle_hashes, span_hashes, stash, word_spans
from skyloom.llm.components import components

SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 4, 25
COORDINATES = ROWS * BANDS
CIRCLE_BITS = 20
#: A pair is not looked at further if fewer of its 100 coordinates agree; at similarity 0.75 that is under 1e-8.
LEAST_AGREEING = 50
#: Ids that a broadcast may hold (8 bytes each); beyond it, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: About the shingle bytes and the members of a block of a large bucket.
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 512

SKETCHES = "doc_id long, text_id long, n_shingles long, fp binary, bands array<long>, sketch binary"


@cache
def circle() -> np.ndarray:
    """Second permutation, continued past its end: a view whose row p holds the values seen from position p under each shift."""
    turn = np.random.default_rng(20230517).permutation(1 << CIRCLE_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((turn, turn[: COORDINATES - 1])), COORDINATES)


def shingle_set(raw: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    data = np.frombuffer(raw.lower(), np.uint8)
    words = span_hashes(data, *word_spans(data))
    return np.unique(shingle_hashes(words, min(SHINGLE, len(words)))) if len(words) else np.zeros(0, U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minima; long sets are taken in pieces to bound memory."""
    at = (mix64(shingles ^ U64(0x5851F42D4C957F2D)) >> U64(64 - CIRCLE_BITS)).astype(np.int64)
    rows = circle()
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(at), 4096):
        np.minimum(least, rows[at[k : k + 4096]].min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A signed 64-bit bucket name for each band."""
    return mix64(shingle_hashes(sig.astype(U64), ROWS)[:: ROWS] + np.arange(1, BANDS + 1, dtype=U64)).astype(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set: its wrapped sum and sum of squares, and its size."""
    with np.errstate(over="ignore"):
        return np.array([shingles.sum(dtype=U64), (mix64(shingles) * shingles).sum(dtype=U64)], U64).tobytes() + len(shingles).to_bytes(4, "little")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, fps, bands, sketches = [], [], [], []
        for raw in batch.column("raw").to_pylist():
            shingles = shingle_set(raw or b"")
            n.append(len(shingles))
            if not len(shingles):
                fps.append(None), bands.append(None), sketches.append(None)
                continue
            sig = signature(shingles)
            fps.append(fingerprint(shingles))
            bands.append(band_keys(sig))
            sketches.append((mix64(sig.astype(U64)) & U64(255)).astype(np.uint8).tobytes())
        arrays = [batch.column("doc_id"), batch.column("text_id"), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_id", "n_shingles", "fp", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(raw or b"").tobytes() for raw in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(found, pa.binary())], names=["node", "node_text", "items"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree often enough."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("sa", "sb"))
            keep = pa.array((a == b).sum(axis=1) >= LEAST_AGREEING)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(few) < PERCENT * len(many):
        return False
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    common = int((many[at] == few).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("ia").to_pylist(), batch.column("ib").to_pylist(), strict=True)
        keep = pa.array([alike(np.frombuffer(x, U64), np.frombuffer(y, U64)) for x, y in pairs], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)


def sketches(docs: DataFrame) -> DataFrame:
    """A row a document with its set's size, fingerprint, bands and sketch, in the shared folder."""
    set_arrow_batches(docs.sparkSession)
    read = docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.col("text").cast("binary").alias("raw"))
    return stash(read.mapInArrow(_sketches, SKETCHES), "neardup")


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(node, node_text, items): the sorted sets of the texts named by ``ids`` (node, node_text), a table of ``n`` rows."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.col("text").cast("binary").alias("raw"))
    wanted = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    match = (F.col("doc_id") == F.col("node")) & (F.col("text_id") == F.col("node_text"))
    return stash(texts.join(wanted, match, "left_semi").mapInArrow(_sets, "node long, node_text long, items binary").dropDuplicates(["node", "node_text"]), "neardup-sets")


def links(pairs: DataFrame, sketch: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs (a, b) that full sets confirm."""
    sa = sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    sb = sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    near = pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long")
    ia = items.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    ib = items.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    return near.join(ib, "b").join(ia, "a").select("a", "b", "ia", "ib").mapInArrow(_confirmed, "a long, b long")


def compared(key, table):
    """Links between the members of two blocks (or within one) that lie in different components, as a forest.

    Common shingles of all pairs are counted at once, as a product of incidence matrices over the shingles that occur on both sides.
    """
    side = table.column("side").to_numpy()
    sets = [np.frombuffer(x, U64) for x in table.column("items").to_pylist()]
    nodes, labels = table.column("node").to_numpy(), table.column("component").to_numpy()
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    common = np.intersect1d(np.unique(np.concatenate([sets[i] for i in left])), np.unique(np.concatenate([sets[i] for i in right])), assume_unique=True)
    counts = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, len(common), 4096):
        part = common[k : k + 4096]
        a, b = incidence([sets[i] for i in left], part), incidence([sets[i] for i in right], part)
        counts += a @ b.T
    size = np.array([len(x) for x in sets], np.float64)
    both = counts.astype(np.float64)
    alike_ = 100 * both >= PERCENT * (size[left][:, None] + size[right][None, :] - both)
    alike_ &= labels[left][:, None] != labels[right][None, :]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(alike_), strict=True):
        a, b = root(labels[left[i]]), root(labels[right[j]])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(labels[left[i]]), int(labels[right[j]])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def incidence(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    """A row a set, a column a shingle of the sorted ``part``: 1 where the set holds it."""
    out = np.zeros((len(sets), len(part)), np.float32)
    for row, items in zip(out, sets, strict=True):
        within = items[np.searchsorted(items, part[0]) : np.searchsorted(items, part[-1], side="right")]
        at = np.searchsorted(part, within)
        row[at[part[at] == within]] = 1
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a shingle of each set."""
    names = ["node", "node_text", "component", "n", "token"]
    for batch in batches:
        for node, text, component, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "node_text", "component", "items")), strict=True):
            items = np.frombuffer(raw, U64)
            n = len(items)
            arrays = [*(pa.array(np.full(n, x, np.int64)) for x in (node, text, component, n)), pa.array(items.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def postings(live: DataFrame) -> DataFrame:
    """(node, node_text, component, n, token, reach): rare shingles of each set, by which sets of different components can be alike.

    ``live`` has node, node_text, component and items. Shingles have one order: those of a single component first, then by how many
    sets hold them. If the first common shingle of two sets is at place i of one with n shingles, at most n - i are common, so the
    other has at most ``reach`` shingles. Places where reach is less than the least size an alike set can have are left out.
    """
    tokens = live.select("node", "node_text", "component", "items").mapInArrow(_tokens, "node long, node_text long, component long, n long, token long")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token", "sets")
    held = tokens.join(shared, "token").groupBy("node", "node_text").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("held"))
    placed = held.select("node", "node_text", "component", "n", (F.col("n") - F.size("held")).alias("own"), F.posexplode("held").alias("at", "h"))
    left = F.col("n") - F.col("own") - F.col("at")
    reach = F.floor(left * (100 + PERCENT) / PERCENT).cast("long") - F.col("n")
    return placed.select("node", "node_text", "component", "n", F.col("h.token").alias("token"), reach.alias("reach")).where(F.col("reach") * 100 >= F.col("n") * PERCENT)


def fitting(rows: DataFrame) -> DataFrame:
    """Postings without those that no posting of another component and a fitting size can meet."""
    about = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"), F.max("reach").alias("most"))
    return rows.join(about.where("lo <> hi"), "token").where("reach >= least and n <= most").select(*rows.columns)


def block_links(members: DataFrame, label: DataFrame, items: DataFrame) -> DataFrame:
    """Links (a, b) between components, from buckets whose members are not all in one component."""
    placed = members.join(label, "node")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    live = placed.join(mixed, "bucket").select("node", "component").distinct()
    live = stash(live.join(items, "node").select("node", "node_text", "component", "items"), "neardup-live")
    rows = stash(fitting(stash(postings(live), "neardup-postings")), "neardup-fitting")
    rows = stash(fitting(rows), "neardup-rare")
    sums = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("sets"))
    sums = sums.groupBy("token").agg(F.sum("sets").alias("size"), F.max(F.struct("sets", "component")).alias("m"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("token", "size", F.col("m.component").alias("main"))
    rows = stash(rows.join(sums, "token").select("node", "node_text", "component", "n", "token", "size", (F.col("component") != F.col("main")).cast("int").alias("minor")), "neardup-mixed")
    # A set's block is in its token with most sets, apart for the sets outside the main component there: the main ones, all of one
    # component, then meet only the others.
    key = ["node", "node_text"]
    home = rows.groupBy(*key).agg(F.max(F.struct("size", "token", "minor")).alias("h"), F.first("component").alias("component"), F.first("n").alias("n")).select(*key, "component", "n", F.col("h.token").alias("home"), F.col("h.minor").alias("minor"))
    parts = F.greatest(F.ceil(F.sum("n") * 8 / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS))
    share = home.groupBy("home", "minor").agg(parts.alias("parts"))
    block = F.xxhash64("home", "minor", F.pmod(F.xxhash64(*key), F.col("parts")))
    placed = stash(home.join(share, ["home", "minor"]).select(*key, "component", block.alias("block")), "neardup-blocks")
    held = rows.select("token", *key).join(placed, key).groupBy("token", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    one, two = (held.select("token", F.col("block").alias(f"b{k}"), F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}")) for k in (0, 1))
    apart = "b0 <= b1 and not (lo0 = hi0 and lo1 = hi1 and lo0 = lo1)"
    pairs = one.join(two, "token").where(apart).select("b0", "b1").distinct()
    sides = pairs.select("b0", "b1", F.col("b0").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where("b0 <> b1").select("b0", "b1", F.col("b1").alias("block"), F.lit(1).alias("side")))
    full = placed.join(live.select(*key, "items"), key)
    return sides.join(full, "block").select("b0", "b1", "side", "node", "component", "items").groupBy("b0", "b1").applyInArrow(compared, "a long, b long")


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, n_shingles, component_id) for every document."""
    found = sketches(docs)
    known = found.where("doc_id is not null and fp is not null")
    classes = stash(known.groupBy("fp").agg(F.min(F.struct("doc_id", "text_id")).alias("first")).select("fp", F.col("first.doc_id").alias("node"), F.col("first.text_id").alias("node_text")), "neardup-classes")
    # A doc_id with several texts may name several classes; it is one node with a row for each of these texts.
    first = known.join(classes, (known.doc_id == classes.node) & (known.text_id == classes.node_text)).select("node", "node_text", "bands", "sketch", "n_shingles").dropDuplicates(["node", "node_text"])
    sketch = stash(first, "neardup-first")
    rows = sketch.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stash(rows.join(size, "bucket"), "neardup-members")
    neighbours = members.groupBy("node").agg(F.sum("size").alias("weight"))
    members = stash(members.join(neighbours, "node"), "neardup-weighted")
    ids = stash(sketch.join(neighbours, "node", "left_semi").select("node", "node_text"), "neardup-ids")
    n = ids.count()
    items = sets_of(docs, ids, n)
    label = None
    if n:
        central = members.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top")).select("bucket", F.col("top.node").alias("pivot"))
        pairs = members.join(central, "bucket").where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        stars = components(links(pairs, sketch, items).select(F.col("a").alias("u"), F.col("b").alias("v")))
        label = stash(ids.select("node").distinct().join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "neardup-stars")
        more = components(block_links(members, label, items).select(F.col("a").alias("u"), F.col("b").alias("v")))
        label = label.join(more.select(F.col("node").alias("component"), F.col("component").alias("final")), "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    if label is not None:
        classes = classes.join(label, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    else:
        classes = classes.select("fp", F.col("node").alias("component"))
    at = found.select("doc_id", "text_id", "n_shingles", "fp").join(classes, "fp", "left")
    return at.select("doc_id", "text_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each group, with the columns of ``docs``."""
    heads = linked(docs).where("component_id is null or doc_id = component_id").select("doc_id", "text_id")
    kept = heads.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_id").alias("text_id")).unionByName(heads.where("doc_id is null").distinct())
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.xxhash64("text").alias("__text_id"))
    match = F.col("__row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("__text_id") == F.col("text_id"))
    joined = keyed.join(kept, match)
    # Rows of one id and text that differ in other columns: the least hash is kept, so that reruns agree.
    one = joined.where("doc_id is not null").groupBy("doc_id").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    once = one.select("__row").unionByName(joined.where("doc_id is null").select("__row"))
    return once.select(*[F.col("__row").getField(c).alias(c) for c in names])


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return linked(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {SHINGLE - 2}))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
sym AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN sym b ON r.y = b.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
