"""The row before and the median, against plain versions."""

import random
import statistics

from pyspark.sql import functions as F

from skyloom.operators import campaign, ordered


def test_lag_crosses_blocks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 5, 10**6, -(10**7), None]) and rng.randrange(-(10**7), 10**7), i) for i in range(300)]
    rows += [("hot", i * 3, 1000 + i) for i in range(3000)] + [("one", 7, 9000), ("tie", 7, 9001), ("tie", 7, 9002)]
    df = spark.createDataFrame(rows, "k string, t long, id long").repartition(5)
    out = ordered.lagged(df, ["k"], "t", ["t", "id"], ["t", "id"], 1000)
    got = {r["id"]: r["before"] and tuple(r["before"]) for r in out.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (before[1:] if before else None) for before, r in zip([None, *own], own, strict=False)}
    assert got == want
    plan = campaign.revisit_gaps(df.select(F.col("t").alias("tca_us"), "k", F.lit("good").alias("quality")), ["k"], ["tca_us"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(k#" in plan and all("__block" in line for line in plan.splitlines() if "windowspecdefinition" in line)


def test_positions_cross_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), rng.choice([None, rng.randrange(-(10**6), 10**6)]), i) for i in range(200)] + [("hot", 5 * i // 7, 1000 + i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t long, id long").repartition(5)
    got = {r["id"]: r["position"] for r in ordered.ranked(df, ["k"], "t", ["t", "id"], 100).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: n for n, r in enumerate(own, 1)}
    assert got == want
    assert ordered.ranked(df.limit(0), ["k"], "t", ["t", "id"], 100).count() == 0


def test_predictions_of_several_sensors_are_one(spark):
    runs = spark.createDataFrame([("r", 1, 5, 50, "second"), ("r", 0, 10, 40, "first"), (None, 2, 1, 2, "other")], "run_id string, ordinal int, start_us long, end_us long, params string")
    passes = spark.createDataFrame([("r", 1, "passes", 20, "B"), ("r", 0, "passes", 20, "A"), ("r", 0, "marginal", 30, "A"), ("r", 1, "passes", 11, "B")], "run_id string, ordinal int, bucket string, tca_us long, satellite string")
    texts = spark.createDataFrame([("r", 1, 0, "x"), ("r", 0, 1, "x"), ("r", 0, 0, "y"), ("r", 0, 1, "x"), ("r", 2, 0, None)], "run_id string, ordinal int, ord int, text string")
    whole, placed, said = campaign.combined(runs, passes, texts, ["satellite"])
    assert {tuple(r) for r in whole.collect()} == {("r", "all", 2, 5, 50, "first"), (None, "all", 1, 1, 2, "other")}
    assert {(r["bucket"], r["tca_us"], r["ordinal"], r["position"]) for r in placed.collect()} == {("passes", 11, 1, 1), ("passes", 20, 0, 2), ("passes", 20, 1, 3), ("marginal", 30, 0, 1)}
    assert {tuple(r) for r in said.collect()} == {("r", "y", 0, 0), ("r", "x", 0, 1), ("r", None, 2, 0)}


def test_median_narrows_to_the_middle(spark):
    rng = random.Random(4)
    groups = {
        "even": [1.0, 2.0, 3.0, 10.0],
        "one": [5.5],
        "ties": [3.0] * 700 + [4.0] * 700,
        "flat": [2.0] * 900,
        "mostly": [1.0] * 1200 + [rng.random() * 1e9 for _ in range(700)],
        "tails": [rng.lognormvariate(0, 9) * rng.choice([-1, 1]) for _ in range(5001)],
        None: [rng.gauss(0, 1) for _ in range(4000)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    for limit, cuts in ((20, 8), (4096, 64)):
        got = {r["k"]: r["median"] for r in ordered.medians(df, ["k"], "v", limit=limit, cuts=cuts).collect()}
        assert got == {k: statistics.median(vs) for k, vs in groups.items()}
    (whole,) = ordered.medians(df.select("v"), [], "v", limit=10, cuts=16).collect()
    assert whole["median"] == statistics.median([v for _, v in rows if v is not None])
    assert ordered.medians(df.limit(0), ["k"], "v").count() == 0
