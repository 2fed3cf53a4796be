"""Order within a key without a sort of the key as a whole: the row before, a row's position, and the exact median.

All keep what a task holds bounded when a key has a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.session import kept

#: Values of a group that are sorted at last; cuts of a sketch, and its relative error in ranks.
LIMIT = 4096
CUTS = 64
ACCURACY = 10_000


def same(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """An equi-join in which nulls are equal; columns of ``by`` are the left's."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in by})
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in by], how).drop(*[f"__r_{k}" for k in by])


def lagged(rows: DataFrame, by: list[str], at: str, order: list[str | Column], columns: list[str], span: int, name: str = "before") -> DataFrame:
    """Rows with struct ``name``: ``columns`` of the row before in ``order`` among those of equal ``by``, null for the first.

    ``order`` begins with the number ``at``. Its range is cut into blocks of ``span``; a window takes a key's block, and the first
    row of a block gets the last one of the key's previous block that has any, from a table of one row a key and block. So
    that table, and a key's entry in it, grow with the range that a key covers, not with its rows. A null ``at`` comes first.
    """
    values = F.struct(*columns)
    block = F.floor(F.col(at) / span).alias("__block")
    blocked = rows.withColumn("__block", block)
    w = W.partitionBy(*by, "__block").orderBy(*order)
    within = blocked.withColumns({"__own": F.lag(values).over(w), "__first": F.row_number().over(w) == 1})
    last = blocked.groupBy(*by, "__block").agg(F.max_by(values, F.struct(*order)).alias("__last"))
    chain = last.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__block", "__last"))).alias("__c"))
    links = F.transform("__c", lambda x, i: F.struct(x["__block"].alias("__block"), F.get(F.col("__c"), i - 1)["__last"].alias("__carried")))
    carried = chain.select(*by, F.explode(links).alias("__l")).select(*by, "__l.*")
    joined = same(within, carried, [*by, "__block"], "left")
    return joined.withColumn(name, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__own"))).drop("__block", "__own", "__first", "__carried")


def ranked(rows: DataFrame, by: list[str], at: str, order: list[str | Column], span: int, name: str = "position") -> DataFrame:
    """Rows with their ``name``, from 1, in ``order`` among those of equal ``by``; it begins with the number ``at``, of which nulls come first.

    A window numbers the rows of a key's block of ``span``, and what the key's blocks before it have is added from a table of one
    row a key and block.
    """
    blocked = rows.withColumn("__block", F.floor(F.col(at) / span))
    within = blocked.withColumn("__own", F.row_number().over(W.partitionBy(*by, "__block").orderBy(*order)))
    sizes = blocked.groupBy(*by, "__block").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__before", F.sum("__n").over(W.partitionBy(*by).orderBy("__block")) - F.col("__n"))  # a row a block
    return same(within, sizes.drop("__n"), [*by, "__block"], "left").withColumn(name, F.col("__before") + F.col("__own")).drop("__block", "__own", "__before")


def medians(rows: DataFrame, by: list[str], value: str, name: str = "median", limit: int = LIMIT, cuts: int = CUTS) -> DataFrame:
    """(by, name): the exact median of the non-null values of each group.

    The ranks wanted are bracketed between two values: a sketch of each group's values in its bracket proposes a narrower one,
    and counting the values below and inside it proves that it holds the ranks. Brackets narrow by about cuts / 3 a round until
    they hold at most ``limit`` values, or equal ones; those are sorted. No task or row holds more of a group than
    ``limit`` values and its sketch.
    """
    values = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    size = F.count(F.lit(1))
    state = values.groupBy(*by).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.lit(0).cast("long").alias("below"), size.alias("inside"), size.alias("n"))
    state = kept(state)
    open_ = (F.col("inside") > limit) & (F.col("lo") < F.col("hi"))
    last = None
    while (most := state.where(open_).agg(F.max("inside"), F.sum("inside")).first())[0] and tuple(most) != last:
        last = tuple(most)
        wide = state.where(open_)
        held = same(values, wide, by, "inner") if by else values.crossJoin(F.broadcast(wide))  # without keys the state is one row
        inside = held.where(F.col("__v").between(F.col("lo"), F.col("hi")))
        sketch = inside.groupBy(*by).agg(F.percentile_approx("__v", [k / cuts for k in range(cuts + 1)], ACCURACY).alias("q"), *[F.first(c).alias(c) for c in ("lo", "hi", "below", "inside", "n")])
        share = lambda rank: (rank - F.col("below")) / F.col("inside")
        low = F.floor((share(_ranks()[0]) - 2 / ACCURACY) * cuts).cast("int")
        high = F.ceil((share(_ranks()[1] + 1) + 2 / ACCURACY) * cuts).cast("int")
        at = lambda k: F.get("q", k)
        new_lo, new_hi = F.when(low > 0, at(low)).otherwise(F.col("lo")), F.when(high < cuts, at(high)).otherwise(F.col("hi"))
        proposed = sketch.select(*by, new_lo.alias("lo2"), new_hi.alias("hi2"), "lo", "hi", "below", "inside", "n")
        held = same(values, proposed, by, "inner") if by else values.crossJoin(F.broadcast(proposed))
        counted = held.groupBy(*by).agg(F.count_if(F.col("__v") < F.col("lo2")).alias("below2"), F.count_if(F.col("__v").between(F.col("lo2"), F.col("hi2"))).alias("inside2"), *[F.first(c).alias(c) for c in ("lo2", "hi2", "lo", "hi", "below", "inside", "n")])
        sure = (F.col("below2") <= _ranks()[0]) & (_ranks()[1] < F.col("below2") + F.col("inside2"))
        narrowed = counted.select(*by, *[F.when(sure, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("lo", "hi", "below", "inside")], "n")
        state = kept(state.where(~open_).unionByName(narrowed))
    flat = state.where("lo = hi").select(*by, F.col("lo").alias(name))
    few = state.where("lo < hi")
    held = same(values, few, by, "inner") if by else values.crossJoin(F.broadcast(few))
    ordered = held.where(F.col("__v").between(F.col("lo"), F.col("hi"))).groupBy(*by).agg(F.sort_array(F.collect_list("__v")).alias("v"), F.first("below").alias("below"), F.first("n").alias("n"))
    pick = lambda rank: F.get("v", (rank - F.col("below")).cast("int"))
    return flat.unionByName(ordered.select(*by, ((pick(_ranks()[0]) + pick(_ranks()[1])) / 2).alias(name)))


def _ranks() -> tuple[Column, Column]:
    """Ranks, from 0, of the middle values of ``n``."""
    return F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
