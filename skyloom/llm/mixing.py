"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words; ``target / source_size`` is the mean number of copies of
its documents. The whole part is certain: each document is taken that many times. The rest
is a sample of unequal inclusion probabilities, tilted to longer documents so that the expected
words are exactly the remaining target. Documents are ranked by random odds over inclusion
odds, and those of lowest rank are taken until the remaining words are filled. So the sample has a fixed size in words.
Where single documents are a notable share of what a source may give (NEAR), the next ranks that fit fill up what the cut leaves
open, and at last the shortest further one is taken if that comes nearer to the target.

Ranks are never sorted per source in one task: words are first summed in buckets of the rank,
and only the bucket in which a source's target is met is sorted. The outcome is one cut per source, and the
decision about a document is then a row-wise predicate.

Null text or a text without words: size 0, never taken. Null source: a source of its own, last. Very long texts: whole.
Null or repeated doc_ids: a row's random number depends on doc_id, text and, among equal rows (repeated rows), a running number,
so each is ranked by itself; which of several equal rows is taken is left open. Ties of ranks: by doc_id, then text and number.
Empty table: no rows. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.llm.common import join_small, n_words, stash

MOST_COPIES = 3
SEED = 20240607
#: Share of a source's target that may stay open at the cut.
NEAR = 0.005
KEY = ["source", "doc_id", "text_id"]
ORDER = ["rank", "doc_id", "text_id", "number"]


def ranked_sources(by_source: DataFrame) -> DataFrame:
    """``by_source`` (one row a source) plus ``place``: its position by code point, null last, without one sorting task."""
    spark = by_source.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(
        by_source.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id()), "mix-order"
    )
    counts = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}  # a row a partition
    before, offsets = 0, {}
    for part in sorted(counts):
        offsets[part] = before
        before += counts[part]
    if not counts:
        return dealt.withColumn("place", F.lit(0).cast("long")).drop("__part")
    lookup = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    within = F.row_number().over(W.partitionBy("__part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("place", (within - 1 + lookup[F.col("__part")]).cast("long")).drop("__part")


def targets(by_source: DataFrame) -> DataFrame:
    """Adds weight (1, 2, 3, repeating by place) and target: min(3 x size, level x weight), where the level makes targets sum to the total."""
    table = stash(ranked_sources(by_source).withColumn("weight", F.col("place") % 3 + 1), "mix-sources")
    cap = F.col("source_size") * MOST_COPIES
    level, held = 0.0, -1
    while True:
        capped = cap <= F.col("weight") * F.lit(level)
        row = table.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(capped, cap).otherwise(0)).alias("fixed"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(capped.cast("int")).alias("held"),
        ).first()
        if row["total"] is None or row["held"] == held or not row["open"]:
            break
        held, level = row["held"], (row["total"] - row["fixed"]) / row["open"]
    return table.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def uniform(seed: int) -> Column:
    """A number in (0, 1) that depends on doc_id, text and the number among equal rows."""
    return (F.shiftrightunsigned(F.xxhash64("doc_id", "text_id", "number", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def copied(sizes: DataFrame) -> tuple[DataFrame, int]:
    """The keys of several equal rows, and their number."""
    many = stash(sizes.where("size > 0").groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), "mix-copied")
    return many, many.count()


def numbered(rows: DataFrame, many: DataFrame, n: int) -> DataFrame:
    """Adds number: 0, 1, ... among equal rows, counted by input partition first, so that no task gets all of them."""
    if not n:
        return rows.withColumn("number", F.lit(0).cast("long"))
    known = join_small(rows, many, KEY, n)
    more = stash(known.where("__n is not null").drop("__n").withColumn("__part", F.spark_partition_id()), "mix-equal")
    parts = more.groupBy(*KEY, "__part").agg(F.count(F.lit(1)).alias("c"))
    earlier = W.partitionBy(*KEY).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = stash(parts.select(*KEY, "__part", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("__before")), "mix-parts")
    found = join_small(more, parts, [*KEY, "__part"], parts.count(), "inner")
    within = F.row_number().over(W.partitionBy(*KEY, "__part").orderBy(F.lit(1)))
    found = found.withColumn("number", (F.col("__before") + within - 1).cast("long")).drop("__part", "__before")
    return known.where("__n is null").drop("__n").withColumn("number", F.lit(0).cast("long")).unionByName(found)


def not_after(bound: str) -> Column:
    """Whether a row's place in ORDER is at most that in the struct ``bound``; null ids come first, as they sort."""
    held = F.struct(*[F.col(c) for c in ORDER])
    return held <= F.col(bound)


def with_rank(sized: DataFrame) -> DataFrame:
    """Adds rank: random odds over inclusion odds, mapped to (0, 1); null where nothing is left to sample."""
    share = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)) - F.col("whole")
    tilt = F.col("size") / (F.col("size") + F.col("mean_size")) - F.col("mean_tilt")
    chance = share + share * (1 - share) * tilt
    u = uniform(SEED)
    odds = F.try_divide((u / (1 - u)) * (1 - chance), chance)
    return sized.withColumn("rank", F.when((F.col("size") > 0) & (share > 0) & (chance > 0), odds / (1 + odds)))


def plan(sized: DataFrame) -> tuple[DataFrame, int]:
    """From (doc_id, text_id, number, source, size): a row a source with its target, whole copies, cut and extra documents, and the number of sources."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = stash(targets(by), "mix-targets")
    many = sources.agg(F.count(F.lit(1)).alias("n"), F.max("n_docs").alias("most")).first()
    n, most = many["n"], many["most"] or 0
    sources = sources.withColumns(
        {
            "mean_size": F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0)),
            "whole": F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long"),
        }
    )
    tilted = join_small(sized, sources.select("source", "mean_size"), ["source"], n)
    means = tilted.groupBy("source").agg(
        (F.sum(F.col("size") * (F.col("size") / (F.col("size") + F.col("mean_size"))).cast("decimal(20,12)")) / F.greatest(F.sum("size"), F.lit(1)))
        .cast("double")
        .alias("mean_tilt")
    )
    sources = stash(join_small(sources, means, ["source"], n), "mix-means")
    buckets = max(4096, 1 << (most // 20_000).bit_length())
    ranked = with_rank(join_small(sized, sources, ["source"], n)).where(F.col("rank").isNotNull())
    ranked = ranked.withColumn("bucket", F.floor(F.col("rank") * buckets).cast("long"))
    filled = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = filled.withColumn("after", F.sum("words").over(upto))
    filled = join_small(filled, sources.select("source", "target", "source_size", "whole"), ["source"], n)
    left = F.col("target") - F.col("whole") * F.col("source_size")
    edge = filled.where(F.col("after") > left).groupBy("source").agg(F.min(F.struct("bucket", "after", "words")).alias("e"))
    edge = stash(edge.select("source", F.col("e.bucket").alias("edge"), (F.col("e.after") - F.col("e.words")).alias("before")), "mix-edges")
    inside = join_small(ranked, edge, ["source"], n, "inner").where(F.col("bucket") == F.col("edge"))
    running = W.partitionBy("source").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(running))
    taken = inside.where(F.col("upto") <= left + F.greatest(F.lit(1.0), F.col("target") * NEAR))
    last = taken.groupBy("source").agg(F.max(F.struct(*ORDER)).alias("last"), F.max("upto").alias("upto"))
    cuts = join_small(join_small(sources, edge, ["source"], n), last, ["source"], n)
    nothing = F.struct((F.col("edge") / float(buckets)).alias("rank"), *[F.lit(-(1 << 63)).cast("long").alias(c) for c in ORDER[1:]])
    cuts = cuts.withColumn("cut", F.when(F.col("edge").isNotNull(), F.coalesce("last", nothing)))
    cuts = cuts.withColumn("open", F.when(F.col("edge").isNotNull(), left - F.coalesce("upto", "before")))
    cuts = stash(cuts.select("source", "source_size", "target", "whole", "mean_size", "mean_tilt", "cut", "open"), "mix-cuts")
    return filled_up(cuts, ranked.select("source", "size", *ORDER), n), n


def filled_up(cuts: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """Adds extra: the places of documents beyond the cut that fill what it leaves open, one a source and round, first those of lowest rank."""
    shape = "array<struct<rank:double,doc_id:bigint,text_id:bigint,number:bigint>>"
    cuts = cuts.withColumn("extra", F.array().cast(shape))
    over = False
    while True:
        wide = cuts.where(F.col("open") > F.greatest(F.lit(1.0), F.col("target") * NEAR)).select("source", "open", "cut", "extra")
        fits = F.col("size") < F.col("open") * 2 if over else F.col("size") <= F.col("open")
        rows = join_small(ranked, wide, ["source"], n, "inner").where(fits & ~not_after("cut"))
        held = F.struct(*[F.col(c) for c in ORDER])
        rows = rows.where(~F.array_contains("extra", held))
        # A document of half of what is open or more at a time, where there is one: rounds go with the logarithm of what is open.
        first = F.col("size") if over else (F.col("size") * 2 < F.col("open")).cast("long")
        best = rows.groupBy("source").agg(F.min(F.struct(first.alias("first"), held.alias("place"), "size")).alias("b"))
        best = stash(best.select("source", "b.place", F.col("b.size").alias("got")), "mix-extra")
        if not over and not best.head(1):
            over = True
            continue
        cuts = join_small(cuts, best, ["source"], n)
        found = F.col("got").isNotNull()
        cuts = stash(cuts.withColumns({"extra": F.when(found, F.concat("extra", F.array("place"))).otherwise(F.col("extra")), "open": F.col("open") - F.coalesce("got", F.lit(0))}).drop("place", "got"), "mix-cuts")
        if over:
            return cuts.drop("open")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_id"), "source", n_words(F.col("text")).alias("size"))


def with_copies(docs: DataFrame, cuts: DataFrame, n: int) -> DataFrame:
    """Adds source_size, target and copies to rows that have doc_id, text_id, number, source and size."""
    ranked = with_rank(join_small(docs, cuts, ["source"], n))
    held = F.struct(*[F.col(c) for c in ORDER])
    below = F.col("rank").isNotNull() & (F.col("cut").isNull() | not_after("cut") | F.array_contains("extra", held))
    copies = F.when(F.col("size") > 0, F.col("whole") + below.cast("long")).otherwise(0)
    return ranked.withColumn("copies", copies.cast("long")).drop("whole", "mean_size", "mean_tilt", "cut", "extra", "rank")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every document."""
    sizes = stash(sized(docs), "mix-sizes")
    sizes = numbered(sizes, *copied(sizes))
    cuts, n = plan(sizes)
    return with_copies(sizes, cuts, n).drop("text_id", "number")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    sizes = stash(sized(docs), "mix-sizes")
    many = copied(sizes)
    cuts, n = plan(numbered(sizes, *many))
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "source", n_words(F.col("text")).alias("size"), row)
    chosen = with_copies(numbered(rows, *many), cuts, n).where("copies > 0")
    repeated = chosen.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col("__row").getField(c).alias(c) for c in names])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
