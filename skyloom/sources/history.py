"""Element-set history as Parquet: what is stored, when it must be fetched anew, and what changed since.

A fetch is appended, never overwritten, so the history can be compared. ``<path>/sets`` has satellite, norad, line1, line2 and
fetched_us; ``<path>/failures`` the times (failed_us) of fetches that failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.sky import HOUR_US
from skyloom.operators import validation
from skyloom.operators.passes import sent
from skyloom.sources.elements import latest, parse_3le

SETS = "satellite string, norad int, line1 string, line2 string, fetched_us long"
FAILURES = "failed_us long"
#: How long stored sets count as fresh, and how long a failed fetch is not repeated.
FRESH_US = 8 * HOUR_US
COOL_US = HOUR_US // 4


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the history; one that can't be found is empty, and a damaged file counts as missing."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def plan(roster: DataFrame, sets: DataFrame, failures: DataFrame, now_us: int) -> DataFrame:
    """(sensor, missing, fetched_us, action) of each sensor of a roster. Its sets are as old as the oldest of the newest of its satellites.

    fresh: all are stored and young enough; cooling: all are stored and a fetch failed a short time ago; fetch: else.
    """
    newest = sets.groupBy("satellite").agg(F.max("fetched_us").alias("fetched_us"))
    held = roster.select("sensor", "satellite").join(newest, "satellite", "left").groupBy("sensor").agg(F.count_if(F.col("fetched_us").isNull()).alias("missing"), F.min("fetched_us").alias("fetched_us"))
    failed = failures.agg(F.max("failed_us").alias("failed_us"))  # one row
    young = F.lit(now_us) - F.col("fetched_us") < FRESH_US
    cooling = F.lit(now_us) - F.col("failed_us") < COOL_US
    covered = F.col("missing") == 0
    action = F.when(covered & young, "fresh").when(covered & cooling, "cooling").otherwise("fetch")
    return held.crossJoin(F.broadcast(failed)).select("sensor", "missing", "fetched_us", "failed_us", action.alias("action"))


def acquire(spark: SparkSession, roster: DataFrame, path: str, now_us: int, get: Callable[[int], str] | None = None) -> tuple[DataFrame, list[str]]:
    """Element sets of one sensor's roster and what there is to say of them; RuntimeError where there are none.

    Fresh sets first, stored ones while a failure cools down, then ``get`` (text by catalogue number), then stored ones whatever
    their age. The roster is a sensor's few satellites, so they are asked for one by one.
    """
    sets, failures = stored(spark, f"{path}/sets", SETS), stored(spark, f"{path}/failures", FAILURES)
    state = plan(roster, sets, failures, now_us).first()
    held = latest(sets, ["satellite", "norad"], ["fetched_us"]).join(sent(roster.select("satellite", "norad")), ["satellite", "norad"])
    age = (now_us - state["fetched_us"]) / HOUR_US if state["fetched_us"] is not None else None
    if state["action"] == "fresh":
        return held, []
    if state["action"] == "cooling":
        return held, [f"The last fetch of element sets failed {(now_us - state['failed_us']) / 6e7:.0f} min ago and is not repeated yet; stored sets of {age:.1f} h are used."]
    try:
        if get is None:
            raise OSError("no way to fetch is set up")
        found = fetched(spark, roster, get, now_us)
    except (OSError, ValueError) as e:
        spark.createDataFrame([(now_us,)], FAILURES).write.mode("append").parquet(f"{path}/failures")
        if state["missing"] or age is None:
            raise RuntimeError(f"element sets could not be fetched and not all are stored: {e}") from e
        return held, [f"Element sets could not be fetched ({e}); stored sets of {age:.1f} h are used. Fetch again before an order."]
    both = held.unionByName(found).select("satellite", "line1", "line2")
    said = [r["text"] for r in validation.manoeuvre_warnings(validation.orbit_changes(both)).orderBy("satellite").collect()]
    found.write.mode("append").parquet(f"{path}/sets")
    return found, said


def fetched(spark: SparkSession, roster: DataFrame, get: Callable[[int], str], now_us: int) -> DataFrame:
    """The roster's sets as they are now; ValueError where an answer holds none."""
    asked = roster.select("satellite", "norad").orderBy("satellite").collect()
    texts = spark.createDataFrame([(r["satellite"], get(r["norad"])) for r in asked], "source string, value string")
    rows = [(r["source"], r["norad"], r["line1"], r["line2"], now_us) for r in parse_3le(texts).select("source", "norad", "line1", "line2").collect()]
    if gone := {r["satellite"] for r in asked} - {r[0] for r in rows}:
        raise ValueError(f"no element set for {', '.join(sorted(gone))}")
    return spark.createDataFrame(rows, SETS)
