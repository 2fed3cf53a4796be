"""The nearest sample against a plain search, borders of blocks, ties and hot keys included."""

import random

from skyloom.operators import asof, clouds


def test_nearest_matches_a_plain_search(spark):
    rng = random.Random(8)
    tolerance = 50
    left = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-3000, 3000), 200 * rng.randrange(-9, 9)]), i) for i in range(500)] + [("hot", i % 400, 1000 + i) for i in range(1200)]
    samples = [(rng.choice(["a", "b", None, "hot"]), rng.choice([None, rng.randrange(-3000, 3000), 100 * rng.randrange(-20, 20)]), i, rng.choice([None, 1.5])) for i in range(400)]
    out = asof.nearest_join(spark.createDataFrame(left, "k string, t long, id long").repartition(4), spark.createDataFrame(samples, "k string, u long, idx long, v double").repartition(3), ["k"], "t", "u", tolerance)
    assert out.columns == ["k", "t", "id", "s"]
    got = {r["id"]: r["s"] and (r["s"]["u"], r["s"]["idx"], r["s"]["v"]) for r in out.collect()}
    want = {}
    for k, t, i in left:
        near = [(abs(u - t), u, idx, v) for kk, u, idx, v in samples if kk == k and u is not None and t is not None and abs(u - t) <= tolerance]
        best = min(near, key=lambda x: x[:3], default=None)
        want[i] = best and best[1:]
    assert len(got) == len(left) and got == want


def test_outlook_reads_the_passes_once(spark):
    passes = spark.createDataFrame([("a", "A", "S", 10**9 * k, "x") for k in range(3)], "aoi_id string, name string, satellite string, tca_us long, s string").drop("s")
    forecast = spark.createDataFrame([("a", 0, 0, 1.0, 1.0, 1.0, 1.0)], "aoi_id string, idx int, t_us long, total double, low double, mid double, high double")
    ensemble = spark.createDataFrame([("a", 0, 0, "m", 1.0)], "aoi_id string, idx int, t_us long, member string, pct double")
    usual = spark.createDataFrame([], "name string, month string, clear_pct double")
    out = clouds.with_clouds(passes, forecast, ensemble, usual, 0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("satellite#") and sum("LogicalRDD" in line and "satellite#" in line for line in plan.splitlines()) == 1
    got = sorted((r["tca_us"], r["cloud"]["tier"], r["cloud"]["optical_obstruction_pct"]) for r in out.collect())
    assert got == [(0, 1, 2.4), (10**9, 1, 2.4), (2 * 10**9, 1, 2.4)]
