"""The status of element sets as a stream, against the batch form at every change and in between."""

import random
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.sky import HOUR_US
from skyloom.sources import history
from skyloom.streaming import refresh

ROSTER = [("a", "A1"), ("a", "A2"), ("b", "A2"), ("b", "B1"), ("c", "C1")]
START = 1_704_067_200_000_000


def row(seen_us, satellite=None, fetched_us=None, failed_us=None):
    return (datetime.fromtimestamp(seen_us / 1e6, UTC), satellite, fetched_us, failed_us)


def parts():
    """Deliveries in order of arrival; within them fetches are told of late, out of order and again, with failures between."""
    draw = random.Random(5)
    out, at = [], START
    for k in range(4):
        rows = []
        for _ in range(12):
            at += draw.randrange(60, 3600) * 1_000_000
            satellite = draw.choice(["A1", "A2", "B1", "X9", None]) if k != 2 else None
            rows.append(row(at, satellite, at - draw.randrange(0, 3 * HOUR_US)) if satellite else row(at, failed_us=at - draw.randrange(0, 600) * 1_000_000))
        out.append([*rows, rows[2]])
        at += (11 if k == 1 else 1) * HOUR_US
    return out


def test_status_follows_the_batch_form(spark):
    roster = spark.createDataFrame(ROSTER, "sensor string, satellite string")
    given = parts()
    frames = [spark.createDataFrame(draw, refresh.NEWS).repartition(3) for draw in given]
    got = sorted((r["as_of_us"], r["sensor"], r["action"], r["missing"], r["fetched_us"], r["failed_us"]) for r in refresh.followed(frames, roster).collect())
    assert {r[2] for r in got} == {"fresh", "cooling", "fetch"}
    last = max(r[0].timestamp() for r in given[-1]) * 1e6
    wants = []
    for k in range(len(given)):
        rows = [r for part in given[: k + 1] for r in part]
        sets = spark.createDataFrame([(r[1], r[2]) for r in rows if r[1]], "satellite string, fetched_us long")
        failures = spark.createDataFrame([(r[3],) for r in rows if r[3]], "failed_us long")
        for sensor in {x[1] for x in got}:
            own = {s for n, s in ROSTER if n == sensor}
            seen = [[round(r[0].timestamp() * 1e6) for r in part if r[1] is None or r[1] in own] for part in given]
            # The rows of delivery k count from its last one that concerns the sensor until the next delivery's first one.
            begin, end = max(seen[k]), min(seen[k + 1]) - 1 if k + 1 < len(given) else int(last)
            for now in {begin, end} | {x[0] - d for x in got for d in (0, 1) if x[1] == sensor and begin <= x[0] - d <= end}:
                wants.append(history.plan(roster.where(F.col("sensor") == sensor), sets, failures, now).withColumn("now", F.lit(now)))
    changes = {(x[0], x[1]) for x in got}
    for want in reduce(DataFrame.unionByName, wants).collect():
        told = [x for x in got if x[1] == want["sensor"] and x[0] <= want["now"]][-1]
        assert told[2] == want["action"], want
        if told[0] == want["now"]:
            assert told[3:] == (want["missing"], want["fetched_us"], want["failed_us"])
            changes.remove((told[0], told[1]))
    assert not changes


def test_status_of_nothing_and_of_unknown_satellites(spark):
    roster = spark.createDataFrame(ROSTER, "sensor string, satellite string")
    rows = [row(START, "X9", START), row(START + 1), (None, "A1", START, None), row(START + 2, "C1", START - 9 * HOUR_US)]
    got = refresh.followed([spark.createDataFrame([], refresh.NEWS), spark.createDataFrame(rows, refresh.NEWS)], roster).collect()
    assert [(r["sensor"], r["action"], r["missing"]) for r in got] == [("c", "fetch", 0)]
