"""Main text of small pages."""

import random
import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from skyloom.llm import html

PROSE = "Long enough to count as prose, with commas, and some more words to be safe."


def test_articles_are_freed_from_what_surrounds_them():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head>
    <body class="post"><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>About, us</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies, {PROSE}</p></div><div id=sidebar><p>{PROSE}</p></div>
    <article><h1>Head &amp; line</h1><p>{PROSE}<p>Second&nbsp;one <b>bold</b>,\n  {PROSE} &eacute;<br>next<ul><li>item, {PROSE}<li>short</ul><!-- <p>no</p> -->
    <div class="ad">Buy, buy, {PROSE}</div><form><p>{PROSE}</p></form></article>
    <section class="comments"><p>reader, {PROSE}</p><p>{PROSE}</p></section><footer>&copy; {PROSE}</footer></body></html>"""
    assert html.main_text(page).split("\n") == ["Head & line", PROSE, f"Second one bold, {PROSE} é next", f"item, {PROSE}", "short"]


def test_without_article_the_best_container_wins_with_its_siblings():
    page = f"<body><div><a href=1>one, link, {PROSE}</a></div><div><p>{PROSE}</p><p>{PROSE * 3}</p></div><p>{PROSE * 2}</p><div><a href=2>{PROSE}</a></div></body>"
    assert html.main_text(page).split("\n") == [PROSE, PROSE * 3, PROSE * 2]


def test_nothing_that_is_no_main_text_stays():
    for name in ("post-comments", "comment-content", "page-footer", "main-menu", "mainMenu", "content sidebar", "entry_share", "advert", "AdBanner"):
        for tag in ("div", "span", "section"):
            page = f"<body><article><p>{PROSE}</p><{tag} class='{name}'>leak, {PROSE}</{tag}><p>{PROSE}</p></article></body>"
            assert html.main_text(page) == f"{PROSE}\n{PROSE}", name
    for name in ("has-sidebar", "content no-comments", "roadside", "reads", "headers-of-state"):
        assert html.main_text(f"<body><div class='{name}'><p>{PROSE}</p></div></body>") == PROSE, name


def test_short_sections_and_loose_text_beside_the_best_stay():
    page = f"<body><div id=a><section><p>{PROSE * 9}</p><p>{PROSE * 9}</p></section><h2>Next</h2><section><p>It is short.</p></section> loose words, <i>here too</i>. <ul><li><a href=x>link</a></li></ul></div></body>"
    assert html.main_text(page).split("\n") == [PROSE * 9, PROSE * 9, "Next", "It is short.", "loose words, here too."]


def test_layout_words_on_wrappers_empty_no_page():
    body = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE * 2}</p>"
    want = ["Title", PROSE, PROSE * 2]
    for wrapper in ("div id=page class='site right-sidebar'", "div class='side-by-side'", "div class='widget-content'", "div class=notice", "form id=aspnet", "div role=dialog", "div class='comments-open'"):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>", f"<article><div class='entry-header'><h1>Title</h1></div><p>{PROSE}</p><p>{PROSE * 2}</p></article>"):
            page = f"<body><nav><p>{PROSE}</p></nav><{wrapper}><div class=menu><a href=x>one</a></div>{inner}<div class='post-comments'><p>reader, {PROSE}</p></div><div class=sidebar><p>aside, {PROSE}</p></div></{wrapper.split()[0]}></body>"
            assert html.main_text(page).split("\n") == want, (wrapper, inner)
    # Readers' comments, however long, and teasers in a sidebar don't hold the page's prose.
    long = "".join(f"<article class=comment><p>{PROSE * 5}</p></article>" for _ in range(9))
    for place in (f"<section class=comments>{long}</section>", f"<div class=sidebar><article><a href=x>{PROSE}</a></article></div>"):
        assert html.main_text(f"<body><div>{body}</div>{place}</body>").split("\n") == want


def test_made_pages_give_their_articles():
    """A plain version by construction: what is put in as the article must come out, whatever is around it and whatever wraps it."""
    rng = random.Random(11)
    layout = ["", "", "class='site has-sidebar'", "class='right-sidebar wide'", "id=header-wrap", "class='widget area'", "class='social promo'", "id=main"]
    around = [lambda: f"<div class='cookie-banner'><p>We use cookies, {PROSE}</p></div>", lambda: f"<aside><p>{PROSE}</p></aside>", lambda: "<nav><ul><li><a href=x>Home</a></li></ul></nav>", lambda: f"<div class=sidebar><p>{PROSE}</p></div>", lambda: f"<footer><p>{PROSE}</p></footer>", lambda: f"<form><p>{PROSE}</p><input></form>", lambda: f"<div id=comments><p>{PROSE}</p><p>{PROSE}</p></div>", lambda: f"<script>var x = '<p>{PROSE}</p>'</script>"]
    for _ in range(200):
        words = [f"Sentence {i} of the article, {' '.join(rng.choices('alpha beta gamma delta'.split(), k=rng.randint(12, 40)))}." for i in range(rng.randint(4, 9))]
        tag = rng.choice(["article", "main", "div", "section"])
        page = f"<{tag}>" + "".join(f"<p>{w}</p>" for w in words) + f"</{tag}>"
        for _ in range(rng.randint(0, 3)):
            parts = [rng.choice(around)() for _ in range(rng.randint(0, 2))] + [page] + [rng.choice(around)() for _ in range(rng.randint(0, 2))]
            wrapper = rng.choice(["div", "div", "form", "section"])
            page = f"<{wrapper} {rng.choice(layout)}>{''.join(parts)}</{wrapper}>"
        assert html.main_text(f"<html><body>{page}</body></html>").split("\n") == words, page


@pytest.mark.parametrize("page", ["<div class=ad>" * 90000 + "x, " * 50, "<div class=sidebar><p>some words, and more of them to count</p>" * 20000, "<div>x y z, " * 90000, "<b>" * 180000 + "</i>" * 180000, "<a '" * 250000, "<ul><li><ul>" + "<div>" * 3000 + "<li>a</li>" * 90000, "<b>" * 20000 + "<p>x" * 200000, "<blockquote>word, " * 60000, '<p title="' * 100000, "<a href=x>" * 100000 + "t", "<td>" * 200000, "<!--" * 200000, "&amp" * 200000])
def test_long_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 20 * len(page) / 1e6


def plain_scores(node):
    """Scores by their definition, each element's text gathered anew."""
    def under(one, linked=False):
        if isinstance(one, str):
            text = re.sub(r"\s+", " ", one)
            return [(len(text), text.count(","), linked)]
        return [] if one.out else [x for c in one.children for x in under(c, linked or one.name == "a")]

    wanted = list(html.walk(node))
    points = {id(n): 0.0 for n in wanted}
    for n in wanted:
        got = under(n)
        if n.name in html.PARAGRAPHS:
            worth, to = html.points_of(sum(x[0] for x in got), sum(x[1] for x in got), sum(x[0] for x in got if x[2])), n.parent
        else:
            own = re.sub(r"\s+", " ", "".join(c for c in n.children if isinstance(c, str))).strip()
            worth, to = html.points_of(len(own), own.count(","), 0), n
        for share in (1, 0.5):
            if to is not None:
                points[id(to)] += worth * share
                to = to.parent
    out = {}
    for n in wanted:
        got = under(n)
        size, linked = sum(x[0] for x in got), sum(x[0] for x in got if x[2])
        out[id(n)] = points[id(n)] * (1.25 if n.name in ("article", "main") else 1) * (1 - min(1, linked / max(1, size)))
    return out


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<li>", "<a href=x>", "</a>", "<b>", "</b>", "<div class=ad>", "some words, and more of them to count ", "tail, "]), max_size=40).map("".join))
def test_scores_match_their_definition(page):
    root = html.tree(page)
    held = html.score(root)
    want = plain_scores(root)
    assert all(abs(n.score - want[id(n)]) < 1e-9 for n in held)
    assert {id(n) for n in held} >= {k for k, v in want.items() if v > 0}


def test_edges(spark):
    assert [html.main_text(x) for x in (None, "", "<p>", "<", "&amp;", "plain text")] == ["", "", "", "<", "&", "plain text"]
    deep = "<div>" * 3000 + f"<p>{PROSE}</p>"
    assert html.main_text(deep) == PROSE
    rows = [(1, "u", None, "x"), (2, None, f"<p>{PROSE}</p>", "y"), (2, None, f"<p>{PROSE}</p>", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("n_chars", F.lit("clash"))
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extracted(pages).collect()) == [(1, "", 0), (2, PROSE, len(PROSE)), (2, PROSE, len(PROSE))]
    assert html.extracted(pages.limit(0)).count() == 0


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<li>", "<td", ">", "text, more", "<script>", "&#x41;", "<!--", "-->", "<a href='", "\""]), max_size=40).map("".join))
def test_never_fails(page):
    assert isinstance(html.main_text(page), str)
