"""The model against a plain one, as a distribution, and the arrays it is made of."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from skyloom.llm import lm
from skyloom.llm.common import U64, mix64


def discounts(counts):
    n = Counter(counts)
    return lm.discounts(n[1], n[2], n[3], n[4])


class Plain:
    """Dictionaries of strings."""

    def __init__(self, texts):
        self.uni, self.bi, self.context = Counter(), Counter(), Counter()
        for words in texts:
            for a, b in zip(["<s>", *words], [*words, "</s>"], strict=True):
                self.uni[b] += 1
                self.bi[a, b] += 1
                self.context[a] += 1
        self.before = Counter(b for _, b in self.bi)
        self.cut, self.low_cut = discounts(self.bi.values()), discounts(self.before.values())
        self.mass = defaultdict(float)
        for (a, _), c in self.bi.items():
            self.mass[a] += self.cut[min(c, 3)]

    def q(self, w):
        total, mass = len(self.bi), sum(self.low_cut[min(n, 3)] for n in self.before.values())
        n = self.before[w]
        return (n - self.low_cut[min(n, 3)]) / total + mass / total / (len(self.uni) + 1)

    def p(self, h, w):
        if not self.context[h]:
            return self.q(w)
        c = self.bi[h, w]
        return (c - self.cut[min(c, 3)]) / self.context[h] + self.mass[h] / self.context[h] * self.q(w)

    def score(self, words):
        return sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *words], [*words, "</s>"], strict=True))

    def base(self, words):
        n, v = sum(self.uni.values()), len(self.uni)
        return sum(math.log10((self.uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words, "</s>"])


def test_scores_match_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 700)
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.8)) % 90}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), "x") for i in range(150)]
    rows += [(200, None, "x"), (201, "", "x"), (202, "Unseen WORDS here\tw1", "x"), (None, "w1 w2", "x"), (203, "W1 w2 é", "x"), (203, "W1 w2 é", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    plain = Plain([(t or "").lower().split() for i, t, _ in rows if not held(i)])
    assert abs(sum(plain.p("w1", w) for w in plain.uni) + plain.p("w1", "never seen") - 1) < 1e-9
    out = lm.scored(docs.repartition(5)).collect()
    assert len(out) == len(rows)
    want = {(i, t): (t or "").lower().split() for i, t, _ in rows}
    by_id = {i: words for (i, _), words in want.items()}
    for r in out:
        words = by_id[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(words) + 1, sum(plain.uni.values()))
        assert r["n_known"] == sum(plain.uni[w] > 0 for w in [*words, "</s>"])
        assert abs(r["base_score"] - plain.base(words)) < 1e-6 * (1 + len(words))
        assert abs(r["score"] - plain.score(words)) < 1e-5 * (1 + len(words))
    assert lm.scored(docs.limit(0)).count() == 0
    assert lm.perplexity(lm.scored(docs)).where("perplexity < 1").count() == 0


class PlainOrders:
    """Dictionaries of word tuples, of any order."""

    def __init__(self, texts, order):
        self.order = order
        texts = [["<s>", *t, "</s>"] for t in texts]
        self.count = [Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1)) for n in range(1, order + 1)]
        self.used = [self.count[-1]]
        for n in range(order - 1, 0, -1):
            before = Counter(g[1:] for g in self.count[n])
            self.used.insert(0, before + Counter({g: c for g, c in self.count[n - 1].items() if g[0] == "<s>" and n > 1}))
        self.cut = [discounts(u.values()) for u in self.used]
        self.total, self.mass = [Counter() for _ in self.used], [defaultdict(float) for _ in self.used]
        for n in range(order):
            for g, c in self.used[n].items():
                self.total[n][g[:-1]] += c
                self.mass[n][g[:-1]] += self.cut[n][min(c, 3)]

    def p(self, h, w):
        n = len(h)
        lower = self.p(h[1:], w) if n else 1 / len(self.count[0])
        if not self.total[n][h]:
            return lower
        c = self.used[n][(*h, w)]
        return (c - self.cut[n][min(c, 3)] + self.mass[n][h] * lower) / self.total[n][h]

    def score(self, words):
        t = ["<s>", *words, "</s>"]
        return sum(math.log10(self.p(tuple(t[max(0, i - self.order + 1) : i]), t[i])) for i in range(1, len(t)))


def test_higher_orders_match_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 700)
    monkeypatch.setattr(lm, "SLICE", 50)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.8)) % 20}" for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(200, None), (201, "never w1 w2 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = [(t or "").split() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    for order in (3, 4):
        plain = PlainOrders(texts, order)
        words = [w for (w,) in plain.count[0] if w != "<s>"]
        assert abs(sum(plain.p(("w1", "w2"), w) for w in [*words, "unseen"]) - 1) < 1e-9
        for r in lm.scored(docs, order).collect():
            own = (dict(rows)[r["doc_id"]] or "").split()
            assert abs(r["score"] - plain.score(own)) < 1e-5 * (1 + len(own))


def test_empty_texts_train_a_trigram_model(spark):
    docs = spark.createDataFrame([(i, "") for i in range(30)], "doc_id long, text string")
    assert all(r["n_tokens"] == 1 and r["score"] <= 0 for r in lm.scored(docs, 3).collect())


def test_query_sees_two_words_of_context(spark, tmp_path):
    rows = [(i, ("a x b " if i % 2 else "c x d ") * 20) for i in range(60)] + [(1000 + i, t) for i in range(60) for t in ("a x b", "a x d")]
    spark.createDataFrame(rows[:60] + [r for r in rows[60:] if zlib.crc32(str(r[0]).encode()) % 10 == 0], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    scores = sorted(r["score"] for r in lm.op3_lm(spark, str(tmp_path)).where("doc_id >= 1000").collect())
    assert scores[-1] - scores[0] > 1


def test_mix_and_planes_are_exact():
    x = np.random.default_rng(0).integers(0, 2**64, 1000, U64)
    assert (lm.unmix64(mix64(x)) == x).all() and (lm.spread(lm.squeezed(x)) == x).all()
