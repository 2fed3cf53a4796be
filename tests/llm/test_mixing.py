"""Targets and sampling of the mix."""

import random

from skyloom.llm import mixing


def levels(sizes):
    """Targets by plain water filling; sizes: source by code point, None last."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    open_, left, out = set(order), sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= full
    return out


def test_targets_and_taken_words(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 400)), rng.choice(["a"] * 6 + ["B", "c", "é", None, "tiny"]), "x") for i in range(3000)]
    rows = [(i, t, s if s != "tiny" or i < 200 else "a", x) for i, t, s, x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    out = mixing.mix(docs).collect()
    sizes, target, taken = {}, {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    assert {k: round(v, 6) for k, v in target.items()} == {k: round(v, 6) for k, v in levels(sizes).items()}
    assert all(abs(taken[s] - target[s]) <= 400 for s in sizes)
    assert all(r["source_size"] == sizes[r["source"]] for r in out)
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in out}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)


def test_edges(spark):
    shape = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], shape)).count() == 0
    rows = [(1, None, "a"), (2, "", None), (3, "one two", "a"), (3, "one two", "a"), (None, "x", "b")]
    out = mixing.mix(spark.createDataFrame(rows, shape)).collect()
    assert sorted(r["size"] for r in out) == [0, 0, 1, 2, 2]
    assert all(r["copies"] == 0 for r in out if not r["size"])
    assert mixing.mix(spark.createDataFrame([(1, None, "a")], shape)).first()["target"] == 0.0


def test_null_and_repeated_ids_come_near_the_target(spark):
    rows = [(None, f"w{i} " * 50, "null ids") for i in range(200)] + [(7, "one two three", "equal rows")] * 1000
    rows += [(i, f"w{i} " * (60 * (i % 5 + 1)), "few") for i in range(20)] + [(i, "w " * 2000, "much") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(docs).collect()
    for source in ("null ids", "equal rows", "few"):
        own = [r for r in out if r["source"] == source]
        taken, target = sum(r["size"] * r["copies"] for r in own), own[0]["target"]
        assert abs(taken - target) <= max(60, 0.01 * target), (source, taken, target)
        assert all(r["copies"] <= 3 for r in own)
    again = mixing.mix(docs.repartition(3)).collect()
    count = lambda rows: sorted((r["source"], str(r["doc_id"]), r["size"], r["copies"]) for r in rows)
    assert count(again) == count(out)
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in out)
