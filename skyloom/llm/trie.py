"""A prefix trie of conversations, from rolling fingerprints.

A node is a distinct sequence of first turns (role, text); the conversations that start with it are its members, and the
smallest member's id names it together with its depth. Conversations may first be rebuilt: the first ``head`` turns are
taken from another one, ``base``.

1. A turn's code is a 64-bit hash of role and text; turns of equal code are compared as texts (least and largest), and codes
   that several turns share get a number each.
2. Turns are sorted by ranges of (conversation, turn), so that a conversation may span many tasks. A numpy scan of each task
   gives every turn its place and a polynomial of the codes up to it; what earlier tasks hold of a conversation is carried in
   a table of one row a task and conversation. A rebuilt conversation's polynomials follow from its own and its base's.
3. Rows of equal depth and polynomial are a candidate group. Each is checked turn by turn against its representative:
   previous label and last turn of all members must be one; by induction over the depth the whole prefixes are. Those that
   differ get a new label at that depth and below, and the check is made again until nothing differs.
4. Rollup to parents in one pass. The nodes named by a conversation are the last ones of its path, a chain. A node's own chain
   gives it a sum from the end of the chain; every other chain below it belongs to a member whose row stands in the node's
   group, so one grouped sum of chain totals over rows adds the rest. There are no rounds over levels.

Null conv_id: the row is left out. Null role or text: empty. Turns are ordered by turn (null first), then role, then text, so
ties and repeated rows have a defined order and are turns each. Texts of any length are compared whole. Empty table: no rows. Other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.llm.common import ODD, U64, join_small, mix64, n_words, set_arrow_batches, stash

#: Turns that may come from the base conversation, at most.
MOST_HEAD = 3
#: Depths of a chain that one window takes.
BLOCK = 4096
#: Ids of a piece of a list that is hashed.
IDS = 1024
BASE = int(ODD)
SCANNED = "conv_id long, part int, nth long, acc long, x long, k int, words long"
REBUILT = "conv_id long, size long, head int, depth array<long>, label array<long>, x array<long>, k array<int>, words array<long>, part array<int>, before array<long>, shift array<long>, times array<long>"
ROWS = "conv_id long, depth long, fp long, pfp long, x long, k int, words long, ends boolean"


def powers(n: np.ndarray) -> np.ndarray:
    """BASE to each (non-negative) power, modulo 2**64."""
    out, square = np.ones(len(n), U64), BASE
    for bit in range(int(n.max()).bit_length() if len(n) else 0):
        out = np.where((n >> bit) & 1 == 1, out * U64(square), out)
        square = square * square % 2**64
    return out


def codes(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    return mix64(x.astype(np.int64).view(U64) + k.astype(U64) * ODD)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and polynomial of each turn among those of its conversation in this task, which are in order."""
    part, last, n, total = TaskContext.get().partitionId(), None, 0, U64(0)
    for batch in batches:
        conv, size = _column(batch, "conv_id"), batch.num_rows
        if not size:
            continue
        first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        start = np.repeat(first, np.diff(np.append(first, size)))
        nth = np.arange(size) - start + 1
        going_on = np.arange(size) < (first[1] if len(first) > 1 else size) if conv[0] == last else np.zeros(size, bool)
        nth[going_on] += n
        term = codes(_column(batch, "x"), _column(batch, "k")) * powers(nth)
        acc = np.cumsum(term, dtype=U64)
        acc -= (acc - term)[start]
        acc[going_on] += total
        last, n, total = conv[-1], nth[-1], acc[-1]
        new = [batch.column("conv_id"), pa.array(np.full(size, part, np.int32)), pa.array(nth), pa.array(acc.view(np.int64))]
        yield pa.RecordBatch.from_arrays([*new, *[batch.column(c) for c in ("x", "k", "words")]], names=["conv_id", "part", "nth", "acc", "x", "k", "words"])


def turn_codes(turns: DataFrame, bits: int) -> DataFrame:
    """(conv_id, turn, role, text, words, x, k): turns with equal (x, k) are equal."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("x", F.shiftright(F.xxhash64("role", "text"), 64 - bits)).withColumn("words", n_words(F.col("text")))
    turn = F.struct("role", "text")
    shared = rows.groupBy("x").agg(F.min(turn).alias("least"), F.max(turn).alias("most")).where("least != most").select("x")
    n = (shared := stash(shared, "trie-codes")).count()
    if not n:
        return rows.withColumn("k", F.lit(0))
    different = join_small(rows.select("x", "role", "text"), shared, ["x"], n, "left_semi").distinct()
    numbered = stash(different.withColumn("k", F.row_number().over(W.partitionBy("x").orderBy("role", "text"))), "trie-turns")
    return rows.join(numbered.hint("merge"), ["x", "role", "text"], "left").withColumn("k", F.coalesce("k", F.lit(0)))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: labels of the root and of the turns from the base, and for each task's share of its own turns how their polynomials move."""
    one = lambda x, k: int(codes(np.array([x], np.int64), np.array([k]))[0])
    undo = pow(BASE, -1, 2**64)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    names = [f.strip().split()[0] for f in REBUILT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            head = r["head"]
            lent = (r["lent"] or [])[:head]
            own = r["own"] or []
            label, total = [0], 0
            for d, turn in enumerate(lent, 1):
                total = (total + one(turn["x"], turn["k"]) * pow(BASE, d, 2**64)) % 2**64
                label.append(total)
            # Own turns beyond the head keep their polynomial, less that of the head, moved by as many places as the base falls short.
            moved = pow(undo, head - len(lent), 2**64)
            left_out = sum(one(t["x"], t["k"]) * pow(BASE, d, 2**64) for d, t in enumerate(own[:head], 1)) % 2**64
            shift, times, before, at, carried = [], [], [], 0, 0
            for p in r["parts"]:
                here = pow(BASE, at, 2**64)
                shift.append(signed((total + moved * (carried - left_out)) % 2**64))
                times.append(signed(moved * here % 2**64))
                before.append(at - head + len(lent))
                carried = (carried + here * p["acc"]) % 2**64
                at += p["nth"]
            size = len(lent) + max(at - head, 0)
            turns = [(0, 0, 0), *[(t["x"], t["k"], t["words"]) for t in lent]]
            rows.append((r["conv_id"], size, head if at else 0, list(range(len(label))), [signed(v) for v in label], *[list(c) for c in zip(*turns, strict=True)], [p["part"] for p in r["parts"]], before, shift, times))
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _labels(bits: int):
    mask = U64(2**bits - 1)

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, acc = _column(batch, "depth"), _column(batch, "acc").astype(np.int64).view(U64)
            fp = _column(batch, "shift").astype(np.int64).view(U64) + _column(batch, "times").astype(np.int64).view(U64) * acc
            before = fp - codes(_column(batch, "x"), _column(batch, "k")) * powers(depth)
            new = [batch.column("conv_id"), batch.column("depth"), pa.array((fp & mask).view(np.int64)), pa.array((before & mask).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*new, *[batch.column(c) for c in ("x", "k", "words", "ends")]], names=["conv_id", "depth", "fp", "pfp", "x", "k", "words", "ends"])

    return labels


def prefixes(turns: DataFrame, head: Column, base: Column, bits: int = 64) -> DataFrame:
    """A row for each conversation and depth (0: the root) with its label, the label before it and its last turn."""
    set_arrow_batches(turns.sparkSession, 4096)
    coded = turn_codes(turns, bits).repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role")
    ordered = coded.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    scanned = stash(ordered.select("conv_id", "x", "k", "words").mapInArrow(_scan, SCANNED), "trie-scan")
    early = F.when(F.col("nth") <= MOST_HEAD, F.struct("nth", "x", "k", "words"))
    shares = scanned.groupBy("conv_id", "part").agg(F.max(F.struct("nth", "acc")).alias("last"), F.sort_array(F.collect_list(early)).alias("early"))
    share = F.struct("part", F.col("last.nth").alias("nth"), F.col("last.acc").alias("acc"), "early")
    # A conversation's shares are at most one a task of the scan.
    convs = shares.groupBy("conv_id").agg(F.sort_array(F.collect_list(share)).alias("parts"))
    convs = stash(convs.withColumn("own", F.slice(F.flatten("parts.early"), 1, MOST_HEAD)), "trie-convs")
    lent = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("lent"))
    plain = F.transform("parts", lambda p: F.struct(p["part"].alias("part"), p["nth"].alias("nth"), p["acc"].alias("acc")))
    asked = convs.withColumn("head", head.cast("int")).withColumn("base", F.when(F.col("head") > 0, base))
    rebuilt = stash(asked.join(lent, "base", "left").select("conv_id", "head", "own", "lent", plain.alias("parts")).mapInArrow(_rebuild, REBUILT), "trie-rebuilt")

    mask = F.lit(-1 if bits == 64 else 2**bits - 1).cast("long")
    zipped = rebuilt.select("conv_id", "size", F.explode(F.arrays_zip("depth", F.col("label").alias("fp"), F.array_insert(F.slice("label", 1, F.size("label") - 1), 1, F.lit(0).cast("long")).alias("pfp"), "x", "k", "words")).alias("t"))
    heads = zipped.select("conv_id", "t.depth", F.col("t.fp").bitwiseAND(mask).alias("fp"), F.col("t.pfp").bitwiseAND(mask).alias("pfp"), "t.x", "t.k", "t.words", (F.col("t.depth") == F.col("size")).alias("ends"))
    moves = rebuilt.select("conv_id", "size", F.size("depth").alias("from"), F.explode(F.arrays_zip("part", "before", "shift", "times")).alias("t")).select("conv_id", "size", "from", "t.*")
    own = scanned.join(moves, ["conv_id", "part"]).withColumn("depth", F.col("before") + F.col("nth")).where(F.col("depth") >= F.col("from"))
    own = own.select("conv_id", "depth", "acc", "shift", "times", "x", "k", "words", (F.col("depth") == F.col("size")).alias("ends"))
    return stash(heads.unionByName(own.mapInArrow(_labels(bits), ROWS)), "trie-rows")


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and nodes after every group was checked against its representative and groups of several prefixes were split."""
    for k in count():
        last = F.struct("pfp", "x", "k")
        groups = rows.groupBy("depth", "fp").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min(last).alias("least"), F.max(last).alias("most"))
        groups = stash(groups, "trie-groups")
        mixed = groups.where("least != most").select("depth", "fp", "least")
        n = mixed.count()
        if not n:
            return rows, groups.select("depth", "fp", F.col("least.pfp").alias("pfp"), "conv_id", "n_convs", "words")
        wrong = join_small(rows, mixed, ["depth", "fp"], n, "inner").where(last != F.col("least"))
        first = stash(wrong.groupBy("conv_id").agg(F.min(F.struct("depth", "fp")).alias("f")).select("conv_id", F.col("f.depth").alias("from"), F.col("f.fp").alias("was")), "trie-split")
        anew = lambda label, depth: F.when(depth >= F.col("from"), F.xxhash64(label, F.col("was"), F.lit(k))).otherwise(label)
        rows = rows.join(first, "conv_id", "left").withColumns({"fp": anew(F.col("fp"), F.col("depth")), "pfp": anew(F.col("pfp"), F.col("depth") - 1)})
        rows = stash(rows.drop("from", "was"), "trie-rows")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined by commas in pieces of at most IDS."""
    for batch in batches:
        depth, fp, ids = (_column(batch, c) for c in ("depth", "fp", "conv_id"))
        if not len(ids):
            continue
        cuts = np.flatnonzero((depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1])) + 1
        edges = [0, *cuts.tolist(), len(ids)]
        starts = [a for lo, hi in zip(edges, edges[1:], strict=False) for a in range(lo, hi, IDS)]
        ends = [*starts[1:], len(ids)]
        listed = list(map(str, ids.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(depth[starts]), pa.array(fp[starts]), pa.array(ids[starts]), pa.array([",".join(listed[a:b]) for a, b in zip(starts, ends, strict=True)])], names=["depth", "fp", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which are in order; the state of one node is all that is held."""
    key, state = None, None
    done: list[tuple[int, int, str]] = []

    def flushed():
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["depth", "fp", "ends_sha256"])

    for batch in batches:
        for depth, fp, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "fp", "ids")], strict=True):
            if key == (depth, fp):
                state.update(b"," + ids.encode())
                continue
            if key:
                done.append((*key, state.hexdigest()))
            key, state = (depth, fp), hashlib.sha256(ids.encode())
        yield flushed()
        done.clear()
    if key:
        done.append((*key, state.hexdigest()))
        yield flushed()


def end_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node. A digest can't be split, but its ids arrive in order, joined to pieces by many tasks."""
    order = ["depth", "fp", "conv_id"]
    ends = rows.where("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ends.mapInArrow(_chunks, "depth long, fp long, first long, ids string")
    return pieces.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "first").mapInArrow(_digests, "depth long, fp long, ends_sha256 string")


def trie(turns: DataFrame, head: Column | None = None, base: Column | None = None, bits: int = 64) -> DataFrame:
    """All nodes. ``head`` and ``base`` are expressions over conv_id; ``bits`` narrows codes and fingerprints (for tests of collisions)."""
    rows, nodes = settled(prefixes(turns, F.lit(0) if head is None else head, F.lit(None).cast("long") if base is None else base, bits))
    key = ["depth", "fp"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pfp").alias("fp")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("words")
    nodes = nodes.join(children, key, "left").select("*", F.coalesce("n_children", F.lit(0)).alias("below"), saved.alias("own")).drop("n_children")

    # A chain's sum from each depth to its end: within blocks of depths, then over the blocks.
    block = F.floor(F.col("depth") / BLOCK)
    down = W.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    nodes = stash(nodes.withColumn("block", block).withColumn("within", F.sum("own").over(down)), "trie-nodes")
    blocks = nodes.groupBy("conv_id", "block").agg(F.sum("own").alias("part"), F.min("depth").alias("top"), F.max((F.col("below") == 0).cast("long")).alias("leaf"))
    later = W.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id")
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("part").over(later), F.lit(0)).alias("after"), F.sum("part").over(whole).alias("total"), F.min("top").over(whole).alias("top"), F.max("leaf").over(whole).alias("leaf"))
    blocks = stash(blocks, "trie-blocks")
    chained = nodes.join(blocks, ["conv_id", "block"])

    chains = blocks.groupBy("conv_id").agg(F.max("total").alias("total"), F.max("top").alias("top"), F.max("leaf").alias("leaf")).where("top > 0 and (total > 0 or leaf > 0)")
    passed = rows.select("conv_id", *key).join(chains.hint("merge"), "conv_id").where("depth < top")
    passed = passed.groupBy(*key).agg(F.sum("total").alias("more"), F.sum("leaf").alias("leaves"))

    root = nodes.where("depth = 0").select("conv_id").first()
    first = F.lit(root[0] if root else None).cast("long")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(first)
    hangs = (F.col("depth") == F.col("top")) & (F.col("depth") > 1)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("pfp"), F.col("conv_id").alias("parent_conv_id"))
    chained = chained.where(~hangs).withColumn("parent_conv_id", parent).unionByName(chained.where(hangs).join(above.hint("merge"), ["depth", "pfp"]))

    all_of = chained.join(passed, key, "left").join(end_digests(rows), key, "left")
    return all_of.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.col("below").alias("n_children"),
        (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
        (F.col("within") + F.col("after") + F.coalesce("more", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie(turns, F.crc32(F.col("conv_id").cast("string")) % 4, F.col("conv_id") - F.col("conv_id") % 20)


SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
  lambda a, x: list_reduce([xor(a, x), 0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))) AS r FROM (SELECT DISTINCT c FROM t)),
h AS (SELECT c, xor(r, 4294967295::BIGINT) % 4 AS h FROM ids),
lent AS (SELECT h.c, t.p AS d, t.role, t.text FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.p <= h.h),
n AS (SELECT c, count(*) AS n FROM lent GROUP BY 1),
own AS (SELECT t.c, t.p - h.h + coalesce(n.n, 0) AS d, t.role, t.text FROM t JOIN h ON h.c = t.c LEFT JOIN n ON n.c = t.c WHERE t.p > h.h),
r AS (SELECT * FROM lent UNION ALL SELECT * FROM own),
w AS (SELECT c, d, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d) AS seq, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM r
  UNION ALL SELECT c, 0, [], 0 FROM h),
s AS (SELECT c, max(d) AS size FROM w GROUP BY 1),
node AS (SELECT d, seq, min(w.c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(CASE WHEN s.size = d THEN CAST(w.c AS VARCHAR) END, ',' ORDER BY w.c), '') AS ends
  FROM w JOIN s ON s.c = w.c GROUP BY 1, 2),
up AS (SELECT n.*, p.conv_id AS parent FROM node n LEFT JOIN node p ON p.d = n.d - 1 AND n.d > 0 AND p.seq = n.seq[1:n.d - 1]),
kid AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n FROM up WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT up.*, coalesce(kid.n, 0) AS n_children FROM up LEFT JOIN kid USING (d, conv_id)),
sub AS (SELECT a.d, a.conv_id, CAST(sum((f.n_convs - 1) * f.words) AS BIGINT) AS saved, count(*) FILTER (f.n_children = 0) AS leaves
  FROM f JOIN w a0 ON a0.c = f.conv_id AND a0.d <= f.d JOIN node a ON a.d = a0.d AND a.seq = a0.seq GROUP BY 1, 2)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(ends) AS ends_sha256 FROM f JOIN sub USING (d, conv_id)
"""
