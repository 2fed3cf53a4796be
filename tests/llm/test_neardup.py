"""Near-duplicate components against all pairs by brute force."""

import random
import re

import pytest

from skyloom.llm import neardup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingles(t))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((root(x), root(y)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def sample(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(rng.choice([1, 2, 40])):
            copy = list(base)
            for _ in range(int(len(base) * rng.choice([0, 0.01, 0.03, 0.05]))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "one two"), (i + 4, "ONE\ttwo"), (i + 5, "one"), (i + 6, "é É"), (i + 7, "x " * 50000)]
    rng.shuffle(rows)
    return rows


def test_components_match_brute_force(spark):
    rows = sample(3)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.linked(docs).collect()}
    assert out == brute(rows)
    kept = neardup.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in out.items() if i == c)


@pytest.mark.parametrize("block", [512, 3])
def test_one_large_group_of_near_copies(spark, monkeypatch, block):
    """Copies of one text with few and many words replaced, often by the same words, so that some link only to some."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(220):
        copy = list(base)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(100)] = f"other{rng.randrange(2)}"
        rows.append((i, " ".join(copy[: rng.choice([100, 100, 85])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.linked(docs).collect()} == brute(rows)


def test_one_id_with_several_texts(spark):
    """Such an id is one node, linked where any of its texts is."""
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "nothing like the others at all"), (2, a + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["component_id"]) for r in neardup.linked(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert len({tuple(sorted((r["doc_id"], r["text"]) for r in neardup.distinct_documents(docs).collect())) for _ in range(2)}) == 1


def test_edges(spark):
    rows = [(None, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [(r["doc_id"], r["component_id"]) for r in neardup.linked(docs).collect()]
    assert sorted(out, key=str) == [(1, 1), (1, 1), (2, 1), (None, None)]
    assert sorted((r["doc_id"] for r in neardup.distinct_documents(docs).collect()), key=str) == [1, None]
    assert neardup.linked(docs.limit(0)).count() == 0


def test_large_graphs_are_spread(spark, monkeypatch):
    from skyloom.llm import components

    monkeypatch.setattr(components, "ONE_TASK_EDGES", 0)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    out = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r["node"], r["component"]) for r in out} == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)}
