"""Fixed spans against the patterns as written, and what contexts add."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import pii

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


PARTS = ["a", "é", "@", ".", "-", "+", " ", "  ", "1", "23", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "192.168.0.1", "256", "0", "x.y@b-c.de", "(", ")", "\n", "%", "٣"]


@settings(max_examples=400)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_fixed_spans_match_patterns_as_written(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for text in ("1" * 200000, "a" * 200000 + "@", "1." * 100000, "+1" + "(" * 200000, "@a" * 100000):
        pii.base_spans(text)


def test_mentions_stand_between_separators():
    def said(text):
        return [text[a:b] for _, a, b in pii.mentions(text, pii.base_spans(text))]

    key = "0123456789abcdef" * 2
    assert said(f'token="{key}"|{key},key={key} and id 123 45 6789.') == [key, key, key, "123 45 6789"]
    assert said("pass: correcthorse or pass=longenough; note: no") == ["correcthorse", "longenough"]
    assert said("a.b@c.org:55512345 x") == ["a.b@c.org", "55512345"]
    assert pii.patterns("my API key: 9911", 12, 16) == {"L api key :", "S key :", "B key : _ "}


def plain_named(edges):
    """Pattern and instance scores as the docstring says, in plain Python: {instance: kind}; edges: {(pattern, instance): kind}."""
    by = {}
    for (p, i), k in edges.items():
        by.setdefault(p, {})[i] = k
    by = {p: v for p, v in by.items() if len(v) >= pii.SUPPORT}
    scores, last = {}, None
    while True:
        trusted = {}
        for p, held in by.items():
            score = {i: (k, 1.0) if k >= 0 else scores.get(i) for i, k in held.items()}
            known = [s for s in score.values() if s]
            for kind in {k for k, _ in known}:
                own = [x for k, x in known if k == kind]
                trust = round(sum(own) / (sum(x for _, x in known) + pii.MISS * (len(held) - len(known)) + 1), 9)
                if len(own) >= pii.SUPPORT and trust >= pii.TRUST:
                    trusted[p] = max(trusted.get(p, (0, 0)), (trust, kind))
        wrong = {}
        for p, (trust, kind) in trusted.items():
            for i, k in by[p].items():
                if k < 0:
                    wrong[i, kind] = wrong.get((i, kind), 1.0) * (1 - trust)
        scores = {}
        for (i, kind), w in wrong.items():
            scores[i] = max(scores.get(i, (-1, 0.0))[::-1], (round(1 - w, 9), kind))[::-1]
        if trusted == last:
            break
        last = trusted
    keys = {i: 4 for p, (_, kind) in trusted.items() if kind == 4 for i, k in by[p].items() if k == 4}
    return {i: k for i, (k, s) in scores.items() if s >= pii.TRUST} | keys


def test_graph_scores_match_plain_ones(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        slot = rng.choice(["mail to", "write to", "key:", "id =", "see", "call", "host"])
        kind = {"mail to": "e", "write to": "ex", "key:": "kkkkx", "id =": "kxx", "see": "exk", "call": "pppx", "host": "i"}[slot]
        n = rng.randint(1000, 1030)
        value = {"e": f"a{n}@b.org", "x": f"Q-{n}-{n}", "k": f"{n:032x}ab", "p": f"+1 555 0{n}99", "i": f"10.0.0.{n % 200}"}[rng.choice(kind)]
        rows.append((i, f"{rng.choice(['then', 'now'])} {slot} {value} {rng.choice(['soon', 'or'])} not"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    edges = {}
    for _, text in rows:
        for k, a, b in pii.mentions(text, pii.base_spans(text)):
            for p in pii.patterns(text, a, b):
                edges[p, text[a:b].lower()] = max(k, edges.get((p, text[a:b].lower()), -1))
    want = plain_named(edges)
    assert len(want) > 20 and {0, 4} <= set(want.values())
    got = {}
    for r in pii.spotted(docs).collect():
        for kind, a, b in (x.split(":") for x in r["spans"].split(",") if x):
            if kind in pii.FOUND:
                got[rows[r["doc_id"]][1][int(a) : int(b)].lower()] = pii.FOUND.index(kind)
    assert got == want


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"words here api key: {i:032x}deadbeef and so on {i}", "x") for i in range(1, 40)]
    rows += [(100, "words here api key: ZZ-9911-QQ-77 and more", "x"), (101, "clean part number AB-12345 of a shelf " + "ab12" * 9, "x")]
    rows += [(102, None, "x"), (103, "", None), (104, "mail a.b@c.org or 10.0.0.1", "x"), (104, "mail a.b@c.org or 10.0.0.1", "x"), (None, "q@r.st", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r["doc_id"]: r for r in pii.spotted(docs).collect()}
    assert out[100]["spans"] == "secret:20:33" and out[101]["spans"] == "" and out[102]["spans"] == ""
    assert out[104]["spans"] == "email:5:14,ip:18:26" and (out[104]["n_email"], out[104]["n_ip"]) == (1, 1) and out[None]["n_email"] == 1
    texts = {r["doc_id"]: r["text"] for r in pii.redacted_documents(docs).collect()}
    assert texts[100] == "words here api key: <SECRET> and more" and texts[104] == "mail <EMAIL> or <IP>" and texts[102] is None and texts[101] == rows[40][1]
    assert pii.redacted_documents(docs).count() == len(rows) and pii.redacted_documents(docs).columns == docs.columns
    assert pii.spotted(docs.limit(0)).count() == 0
