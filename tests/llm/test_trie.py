"""The trie against one made of Python dictionaries, with and without forced collisions."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skyloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def rebuilt():
    """The query's rule: how many turns, and whose."""
    return F.crc32(F.col("conv_id").cast("string")) % 4, F.col("conv_id") - F.col("conv_id") % 20


def plain(rows, rebuilt=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = set()
    for p, m in members.items():
        todo, saved, leaves = [p], 0, 0
        while todo:
            q = todo.pop()
            saved += (len(members[q]) - 1) * words(q)
            leaves += not kids[q]
            todo += kids[q]
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made():
    rows = []
    for c in range(120):
        for t in range(c * 7 % 9):
            text = f"turn {t} kind {c % (2 + t)}" if c % 3 else f"own {c} {t}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text, "x"))
    rows += [(200, None, "user", "b", ""), (200, None, "user", "a", ""), (200, 0, None, None, ""), (200, 0, None, None, ""), (201, 1, "user", "", None), (None, 1, "user", "gone", "")]
    rows += [(300 + i, t, "user", f"same {t}", "") for i in range(30) for t in range(4)]
    rows += [(400, t, "user", "word " * (t % 5), "") for t in range(3000)] + [(401, t, "user", "word " * (t % 5) if t < 2500 else "other", "") for t in range(2900)]
    rows += [(i, 0, "user", "long " * 40000, "") for i in (420, 421)] + [(i, t, "", " é\n x", "") for i in (422, 425) for t in range(5)] + [(-3, t, "user", "minus", "") for t in range(5)]
    return rows


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_trie(spark):
    rows = made()
    turns = spark.createDataFrame(rows, SCHEMA).repartition(7)
    small = [r for r in rows if r[0] is None or not 400 <= r[0] <= 401]
    few = spark.createDataFrame(small, SCHEMA)
    assert found(trie.trie(few, *rebuilt())) == plain(small)
    assert found(trie.trie(few)) == plain(small, rebuilt=False)
    # Chains of thousands of turns span tasks and blocks of depths; the plain walk over subtrees would take too long, so only this check.
    deep = {(r["conv_id"], r["depth"]): r for r in trie.trie(turns.where("conv_id in (400, 401)")).collect()}
    assert len(deep) == 1 + 3000 + 400 and deep[400, 2500]["n_convs"] == 2 and deep[400, 2500]["n_children"] == 2 and deep[401, 2501]["parent_conv_id"] == 400
    assert deep[400, 0]["saved_tokens"] == sum(t % 5 for t in range(2500)) and deep[400, 0]["n_leaves"] == 2


def test_shared_codes_and_labels_are_split(spark):
    rows = [(c, t, "user", f"{(c >> t) & 1} {t}", "") for c in range(16) for t in range(4)] + [(30, 0, "assistant", "0 0", "")]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert found(trie.trie(turns, bits=3)) == plain(rows, rebuilt=False)
    assert found(trie.trie(turns, *rebuilt(), bits=2)) == plain(rows)


def test_nothing(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA), *rebuilt()).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b", "")], SCHEMA)).count() == 0


@pytest.mark.parametrize("size", [1, 70000])
def test_powers(size):
    import numpy as np

    n = np.array([0, 1, 2, size])
    assert trie.powers(n).tolist() == [pow(trie.BASE, int(k), 2**64) for k in n]
