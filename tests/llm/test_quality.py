"""Quality figures against a plain count, and the verdicts on small tables."""

from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from skyloom.llm import quality


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@given(st.lists(st.sampled_from(["a", "b", "é", "\n", " ", "\t", "#", "\x1c", "日本", "c d"]), max_size=120).map("".join))
def test_figures_match_plain_count(text):
    assert quality.figures(text.encode())[:5] == plain(text)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")


def test_edges(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None, "a", "x"), (2, "", None, None), (3, good, None, "x"), (3, good, None, "x"), (4, "x " * 300, "a", "x")]
    out = {(r["doc_id"], r["kept"], r["base_failed"]) for r in quality.judged(table(spark, rows)).collect()}
    assert out == {(1, False, True), (2, False, True), (3, True, False), (4, False, True)}
    assert quality.judged(table(spark, [])).count() == 0
    assert [r["doc_id"] for r in quality.quality_documents(table(spark, rows)).collect()] == [3, 3]


def test_shared_lines_deplete_documents(spark):
    shared = " ".join(f"menu{chr(97 + i)}" for i in range(20))
    rows = [(i, shared + "\n" + f"only {i} here", "host", "") for i in range(30)]
    rows += [(100 + i, " ".join(f"t{i}x{chr(97 + k)}" for k in range(25)) + "\n" + shared, "host", "") for i in range(5)]
    rows += [(200, shared + "\nother host", "elsewhere", "")]
    out = {r["doc_id"]: r["kept"] for r in quality.judged(table(spark, rows)).collect()}
    assert not any(out[i] for i in range(30)) and all(out[100 + i] for i in range(5)) and out[200]
    texts = {r["doc_id"]: r["text"] for r in quality.quality_documents(table(spark, rows)).collect()}
    assert shared not in texts[100] and shared in texts[200]


def test_documents_are_counted_and_no_host_is_too_large(spark, monkeypatch):
    own = lambda i: " ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{chr(97 + k)}" for k in range(25))
    menu, much, copied = (" ".join(f"{w}{chr(97 + i)}" for i in range(30)) for w in ("menu", "much", "copied"))
    rows = [(i, own(i) + (f"\n{menu}" if i < 24 else ""), "host", "") for i in range(2400 - 60)]
    # A line of twelve texts, one of which has 49 copies: 61 documents, and 60 copies of one text that share no line with others.
    rows += [(3000 + i, own(3000 + min(i, 11)) + "\n" + much, "host", "") for i in range(61)]
    rows += [(4000 + i, copied, "host", "") for i in range(60)] + [(5000, "word " * 5 + "x y z " * 60000, "host", "")]
    out = {r["doc_id"]: r["removed_words"] for r in quality.judged(table(spark, rows)).collect()}
    assert all(out[i] == 0 for i in range(24)) and all(out[3000 + i] == 30 for i in range(61)) and all(out[4000 + i] == 0 for i in range(60)) and out[5000] == 0
    monkeypatch.setattr(quality, "MOST_DOCS", 20)
    out = {r["doc_id"]: r["removed_words"] for r in quality.judged(table(spark, rows)).collect()}
    assert all(out[i] == 30 for i in range(24)) and out[24] == 0 and out[4000] == 0


def test_null_ids_stay_and_each_source_judges_its_own(spark):
    shared = " ".join(f"menu{chr(97 + i)}" for i in range(20))
    own = " ".join(f"t{chr(97 + k)}" for k in range(25))
    rows = [(i, shared + "\n" + f"only {i} here", "host", "") for i in range(30)]
    rows += [(300, own + "\n" + shared, s, "") for s in ("host", "elsewhere", None)] + [(301, shared + "\nshort", s, "") for s in ("host", "elsewhere")]
    rows += [(None, own, s, "") for s in ("elsewhere", None, None)] + [(None, "too short", None, "")]
    out = sorted(((r["doc_id"], r["source"], r["text"]) for r in quality.quality_documents(table(spark, rows)).collect()), key=str)
    want = [(300, "host", own), (300, "elsewhere", own + "\n" + shared), (300, None, own + "\n" + shared), (301, "elsewhere", shared + "\nshort")]
    want += [(None, "elsewhere", own), (None, None, own), (None, None, own)]
    assert out == sorted(want, key=str)
