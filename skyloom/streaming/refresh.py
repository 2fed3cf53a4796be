"""The state of stored element sets as a stream: fresh, cooling or to be fetched, sensor by sensor, as fetches and failures come in.

The batch form is ``sources.history.plan``. Here each change of a sensor's action is a row, dated by when it came about: by a fetch or
a failure, or because time ran out (sets turned stale, a failure cooled down), for which timers are set. Spark's own time to live runs on
processing time and would forget stale sets, which must still be reported; so limits are timers of event time, and sets stay in the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyloom.functions.sky import to_us
from skyloom.operators.passes import sent
from skyloom.session import shared_folder
from skyloom.sources.history import COOL_US, FRESH_US

NEWS = "seen timestamp, satellite string, fetched_us long, failed_us long"
_REDUCED = "sensor string, satellite string, known long, fetched_us long, failed_us long, first_us long, last_us long, seen timestamp"
STATUS = "sensor string, as_of_us long, missing long, fetched_us long, failed_us long, action string"
#: transformWithState needs this store. Keys are sensors, so few partitions do.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = 4


def _reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's newest fetch and failure of each satellite, before the shuffle; at most a row a satellite and sensor is held."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        held = batch.groupby(["sensor", "satellite", "known"], dropna=False, as_index=False).agg({"fetched_us": "max", "failed_us": "max", "first_us": "min", "last_us": "max", "seen": "max"})
    if held is not None:
        yield held


def action_at(now_us: int, missing: int, fetched_us: int | None, failed_us: int | None) -> str:
    """What ``history.plan`` says at a time."""
    if missing or fetched_us is None:
        return "fetch"
    if now_us - fetched_us < FRESH_US:
        return "fresh"
    return "cooling" if failed_us is not None and now_us - failed_us < COOL_US else "fetch"


def _ends(missing: int, fetched_us: int | None, failed_us: int | None) -> list[int]:
    """When limits run out, in order."""
    ends = [x + span for x, span in ((fetched_us, FRESH_US), (failed_us, COOL_US)) if x is not None]
    return [] if missing else sorted(ends)


class Status(StatefulProcessor):
    """State of a sensor: the newest fetch of each of its satellites, the newest failure, and the clock and action last reported."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getMapState("newest", "satellite string", "fetched_us long")
        self.said = handle.getValueState("said", "known long, failed_us long, as_of_us long, action string")

    def _passed(self, fetched: list[int], until_us: int) -> list[tuple]:
        """Changes that time alone brings after the last report and up to ``until_us``."""
        known, failed_us, as_of_us, action = self.said.get()
        oldest, missing, out = min(fetched, default=None), known - len(fetched), []
        for end in _ends(missing, oldest, failed_us):
            if as_of_us < end <= until_us:
                as_of_us, before, action = end, action, action_at(end, missing, oldest, failed_us)
                if action != before:
                    out.append((end, missing, oldest, failed_us, action))
        self.said.update((known, failed_us, as_of_us, action))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, news, failures, known, first, last = {k[0]: v[0] for k, v in self.newest.iterator()}, {}, [], 0, [], []
        for batch in rows:
            known = max(known, int(batch["known"].max()))
            first.append(int(batch["first_us"].min())), last.append(int(batch["last_us"].max()))
            failures.append(batch["failed_us"].max())
            for satellite, us in batch.dropna(subset=["satellite", "fetched_us"]).groupby("satellite")["fetched_us"].max().items():
                news[satellite] = max(news.get(satellite, 0), int(us))
        out, failed_us, as_of_us, action = [], None, None, None
        if self.said.exists():
            out = self._passed(list(held.values()), min(first))
            _, failed_us, as_of_us, action = self.said.get()
        for satellite, us in news.items():
            if satellite not in held or us > held[satellite]:
                held[satellite] = us
                self.newest.updateValue((satellite,), (us,))
        failed_us = max([int(x) for x in (failed_us, *failures) if not pd.isna(x)], default=None)
        as_of_us = max(last) if as_of_us is None else max(as_of_us, *last)
        oldest, missing = min(held.values(), default=None), known - len(held)
        now = action_at(as_of_us, missing, oldest, failed_us)
        if now != action:
            out.append((as_of_us, missing, oldest, failed_us, now))
        self.said.update((known, failed_us, as_of_us, now))
        for end in _ends(missing, oldest, failed_us):
            if end > as_of_us:
                self.handle.registerTimer(-(-end // 1000))  # one that news overtakes finds nothing to report
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame(key[0], self._passed([v[0] for _, v in self.newest.iterator()], expiredTimerInfo.getExpiryTimeInMs() * 1000))

    def close(self) -> None:
        pass


def _frame(sensor: str, rows: list[tuple]) -> pd.DataFrame:
    names = ["as_of_us", "missing", "fetched_us", "failed_us"]
    frame = pd.DataFrame(rows, columns=[*names, "action"]).astype(dict.fromkeys(names, "Int64") | {"action": object})
    frame.insert(0, "sensor", sensor)
    return frame


def status(news: DataFrame, roster: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Changes of each sensor's action, from a stream of fetches and failures (``NEWS``).

    ``seen`` is when a row arrived, by the source's clock, and drives the watermark; ``fetched_us`` may be of any age and order, so a fetch
    that is told of late counts from when it is. A row with a satellite and ``fetched_us`` is a fetch, one with ``failed_us`` a failure, which
    holds for all sensors. Rows of satellites that are in no roster, and rows without ``seen``, change nothing. What a micro-batch brings
    counts from its last row on. A sensor that no row concerns isn't in the result.
    """
    sizes = roster.groupBy("sensor").agg(F.count(F.lit(1)).alias("known"))
    own = roster.select("sensor", "satellite").where("satellite is not null")
    keys = own.unionByName(sizes.select("sensor", F.lit(None).cast("string").alias("satellite"))).join(sizes, "sensor")
    keys = sent(keys.withColumnRenamed("satellite", "of"))
    told = news.select(*[F.col(c.split()[0]) for c in NEWS.split(", ")]).where("seen is not null and (failed_us is not null or (satellite is not null and fetched_us is not null))")
    told = told.withColumn("satellite", F.when(F.col("failed_us").isNull(), F.col("satellite")))
    dealt = told.join(keys, F.col("satellite").eqNullSafe(F.col("of"))).withColumn("first_us", to_us(F.col("seen")))
    rows = dealt.select("sensor", "satellite", "known", "fetched_us", "failed_us", "first_us", F.col("first_us").alias("last_us"), "seen").mapInPandas(_reduce, _REDUCED)
    return rows.withWatermark("seen", late).groupBy("sensor").transformWithStateInPandas(Status(), STATUS, "Append", "EventTime")


def follow(news: DataFrame, roster: DataFrame, out: str, late: str = "0 seconds") -> None:
    """Take in all that ``news`` has and that isn't in ``<out>/status`` yet; its place in the stream and its state are in ``<out>/checkpoint``."""
    conf = news.sparkSession.conf
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.shuffle.partitions": str(PARTITIONS)}
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        sink = status(news, roster, late).writeStream.format("parquet").outputMode("append").option("path", f"{out}/status")
        sink.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def followed(parts: list[DataFrame], roster: DataFrame) -> DataFrame:
    """Status changes of news that come in several deliveries, each written to a folder that the stream reads."""
    spark = roster.sparkSession
    out = shared_folder(spark, "element-status")
    for part in parts:
        part.select(*[F.col(c.split()[0]) for c in NEWS.split(", ")]).write.mode("append").parquet(f"{out}/news")
        follow(spark.readStream.schema(NEWS).parquet(f"{out}/news"), roster, out)
    return spark.read.schema(STATUS).parquet(f"{out}/status")
