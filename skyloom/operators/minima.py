"""Local minima of a series, and golden-section refinement as a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The golden ratio's inverse; 13 steps take a bracket of 40 s below 0.1 s.
SHRINK = (5**0.5 - 1) / 2
CUTOFF_DEG = 70.0


def local_minima(series: DataFrame, by: list[str], order: str, value: str, cutoff: float = CUTOFF_DEG) -> DataFrame:
    """Rows lower than the one before and no higher than the one after; ends never count."""
    w = W.partitionBy(*by).orderBy(order)
    both = series.withColumns({"__before": F.lag(value).over(w), "__after": F.lead(value).over(w)})
    found = both.where((F.col(value) < F.col("__before")) & (F.col(value) <= F.col("__after")) & (F.col(value) < cutoff))
    return found.drop("__before", "__after")


def golden(f: Callable[[Column], Column], low: Column, high: Column, steps: int) -> Column:
    """Middle of the bracket after ``steps`` golden-section cuts of [low, high]."""

    def cut(s: Column, _: Column) -> Column:
        c = s["b"] - SHRINK * (s["b"] - s["a"])
        d = s["a"] + SHRINK * (s["b"] - s["a"])
        left = f(c) < f(d)
        return F.struct(F.when(left, s["a"]).otherwise(c).alias("a"), F.when(left, d).otherwise(s["b"]).alias("b"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(low.cast("double").alias("a"), high.cast("double").alias("b")), cut)
    return (done["a"] + done["b"]) / 2
