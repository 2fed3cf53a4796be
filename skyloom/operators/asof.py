"""Nearest-in-time join within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Tolerances that one block of time holds.
BLOCK = 4


def nearest_join(left: DataFrame, samples: DataFrame, by: list[str], left_us: str, sample_us: str, tolerance_us: int) -> DataFrame:
    """Left rows with ``s``, the nearest sample of the same keys (nulls equal) within the tolerance, or null.

    One pass over each side: both are laid in one table, cut into blocks of time by key, and a row takes the last sample before and the first
    after it within its block. Samples less than the tolerance from a block's border lie in both blocks, so nothing is carried over
    and no key is ordered as a whole. Of equally near samples the earlier counts; of several at one time that of lowest ``idx``.
    """
    block = lambda t: F.floor(t / (BLOCK * tolerance_us))
    t = F.col(sample_us)
    rest = [c for c in samples.columns if c not in (*by, "idx", sample_us)]
    # One sample a time and key suffices, that of lowest index.
    cut = samples.where(t.isNotNull()).groupBy(*by, sample_us).agg(F.min(F.struct("idx", *rest)).alias("__s"))
    cut = cut.select(*by, F.explode(F.array_distinct(F.array(block(t - tolerance_us), block(t), block(t + tolerance_us)))).alias("__block"), t.alias("__t"), F.struct(t.alias(sample_us), "__s.*").alias("__s"))
    rows = left.select(*by, block(F.col(left_us)).alias("__block"), F.col(left_us).alias("__t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__l"))
    both = rows.unionByName(cut, allowMissingColumns=True)
    w = W.partitionBy(*by, "__block")
    # Samples come before rows of their own time in both directions.
    last = lambda *order: F.last("__s", ignorenulls=True).over(w.orderBy(*order, F.col("__l").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow))
    seen = both.withColumns({"__before": last(F.col("__t")), "__after": last(F.desc("__t"))}).where("__l is not null")
    gap = lambda s: F.abs(F.col(f"{s}.{sample_us}") - F.col("__t"))
    far = F.lit(tolerance_us + 1)
    before, after = F.coalesce(gap("__before"), far), F.coalesce(gap("__after"), far)
    nearest = F.when((before <= after) & (before <= tolerance_us), F.col("__before")).when((after < before) & (after <= tolerance_us), F.col("__after"))
    return seen.select("__l.*", nearest.alias("s"))
