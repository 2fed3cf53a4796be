"""Main text of web pages by tree scoring.

A page becomes a tree of elements (markup is mended as browsers do: paragraphs and list items end where the next
block begins, unclosed elements at their parent's end). Scripts, styles and other things that hold no prose are left out, by
their names. A form, or an element whose role, class or id says menu, header, footer, sidebar, notice, advert or comment, is
only suspected: it goes unless the page's prose is in it (``settle``), as with a wrapper named for its layout. Each paragraph gives points for its length and commas to its parent, and half to its grandparent; a
container's points are discounted by its link density. The best container is kept with those siblings that score near it or
read like prose, and the prose between them. Its blocks are the text: white space within a block becomes one space, blocks
are joined by \\n.

Null or empty html, or no prose: an empty string. Any row of any size is handled alone, in time and memory linear in its
size. Ties of the best container: the first in the page. Repeated rows get equal rows; other columns, of any name, are not
read. Empty table: no rows.
"""

from __future__ import annotations

import heapq
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import set_arrow_batches

#: Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
DROPPED = frozenset("script style textarea title noscript template iframe noembed noframes head nav header footer aside button select option input label fieldset dialog svg canvas object embed audio video map menu math".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption dt th caption summary address".split())
FREE = frozenset("p h1 h2 h3 h4 h5 h6 br".split())
NOT_MAIN = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget widgets ad ads advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription share sharing social related recommended comment comments commenting disqus respond replies reply pagination pager login signup search toolbar skip disclaimer gdpr outbrain taboola".split())
NOT_SAID = frozenset("has with no non not without is are hide show".split())
COMMENTS = frozenset("comment comments commenting disqus respond replies reply".split())
#: What an article's own header is called, which holds its title.
OWN_HEADER = frozenset("entry post article story".split())
#: How many times the points of all that is not suspected an element must have to hold the page's prose.
HOLDS = 3

_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
# An attribute whose quote never ends ends its tag there, so that every character is looked at once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: What a start tag closes: elements left open above it, up to a border; each family's elements know their next one above.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}, 1), "dt": ({"dt", "dd"}, {"dl"}, 2), "dd": ({"dt", "dd"}, {"dl"}, 2), "tr": ({"tr", "td", "th"}, {"table"}, 3), "td": ({"td", "th"}, {"table", "tr"}, 3), "th": ({"td", "th"}, {"table", "tr"}, 3), "option": ({"option"}, {"select"}, 4)}
_FAMILY = {name: family for closed, borders, family in _CLOSES.values() for name in closed | borders}
_WHITE = re.compile(r"\s+")

BASE_POINTS, PER_CHARS, MOST_FOR_LENGTH, LEAST_CHARS = 1, 100, 3, 25
SIBLING_SHARE = 0.2
PROSE_CHARS = 80
LEAST_SCORE = 10
MOST_LINKED = 0.25
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SENTENCE = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*\Z")


class Node:
    """An element with its children: nodes and strings. ``near``: the next block, and the next element of each family, at or above it."""

    __slots__ = ("name", "parent", "children", "out", "suspect", "near", "chars", "linked", "commas", "points", "score")

    def __init__(self, name: str, parent: Node | None, out: bool, suspect: int = 0):
        self.name, self.parent, self.out, self.suspect = name, parent, out, suspect
        self.children: list = []
        self.chars = self.linked = self.commas = 0
        self.score = self.points = 0.0
        near = parent.near if parent else (self,) * 5
        family = _FAMILY.get(name, 0)
        if name in BLOCKS or family:
            near = tuple(self if k == family or k == 0 and name in BLOCKS else one for k, one in enumerate(near))
        self.near = near


def says_unwanted(names: str) -> int:
    """Whether one of the class names or ids has a word for what is no main text, as ``mainMenu`` and ``advert`` do and ``has-sidebar`` does not: 1, or 2 for readers' comments."""
    found = 0
    for name in names.split():
        last = ""
        for word in _WORDS.findall(name):
            word = word.lower()
            if word in NOT_MAIN and last not in NOT_SAID and not (word == "header" and last in OWN_HEADER):
                found = max(found, 2 if word in COMMENTS else 1)
            last = word
    return found


def unwanted(name: str, attributes: str) -> tuple[bool, int]:
    """Whether an element holds no main text by its name or as it is hidden, and whether it is suspected of that."""
    if name in DROPPED:
        return True, 0
    suspect = int(name == "form")
    if not attributes or name in ("html", "body", "article", "main"):
        return False, suspect
    given = {}
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        given.setdefault(key.lower(), a or b or c)
    if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
        return True, 0
    suspect = max(suspect, int(given.get("role", "").lower() in _ROLES))
    return False, max(suspect, says_unwanted(f"{given.get('class', '')} {given.get('id', '')}"))


def tree(page: str) -> Node:
    """The element tree of a page."""
    root = Node("#root", None, False)
    at, place, size = root, 0, len(page)
    open_: dict[str, int] = {}
    body = any_suspect = False

    def up(node: Node, to: Node) -> Node:
        while node is not to:
            open_[node.name] -= 1
            node = node.parent
        return to

    while place < size:
        found = _TOKEN.search(page, place)
        if not found:
            at.children.append(page[place:])
            break
        if found.start() > place:
            at.children.append(page[place : found.start()])
        place = found.end()
        name = found[3]
        if name is None:
            if found[1]:
                at.children.append(found[1].replace("&", "&amp;"))
            continue
        name = name.lower()
        if found[2]:
            if open_.get(name):
                node = at
                while node.name != name:
                    node = node.parent
                at = up(at, node.parent)
            elif name in ("p", "br"):
                at.children.append(Node(name, at, at.out))
            continue
        if name in BLOCKS and name != "html" and name != "body":
            node = at.near[0]
            if node.name == "p" or (node.name in FREE and name in FREE):
                at = up(at, node.parent)
        if name in _CLOSES:
            closed, borders, family = _CLOSES[name]
            node, last = at.near[family], None
            while node is not root and node.name not in borders:
                if node.name in closed:
                    last = node
                node = node.parent.near[family]
            if last is not None:
                at = up(at, last.parent)
        if name in ("html", "body") and body:
            continue
        body = body or name == "body"
        out, suspect = unwanted(name, found[4])
        any_suspect = any_suspect or bool(suspect)
        node = Node(name, at, at.out or out, suspect)
        at.children.append(node)
        if name in RAW:
            end = _END[name].search(page, place)
            place = end.end() if end else size
        elif name not in VOID and not found[4].endswith("/"):
            at = node
            open_[name] = open_.get(name, 0) + 1
    if any_suspect:
        settle(root)
    return root


def settle(root: Node) -> None:
    """Leaves out the suspected elements, but for those that hold the page's prose.

    Their paragraphs' points and text are weighed against those of all that is not suspected, the heaviest element first. One stays if
    it has more than HOLDS times as much of both, or as many points and the page's only article or main element; readers' comments only
    if nothing else has any text. Where an article or main element with text is outside, none without one stays. What is suspected within
    one that stays is weighed in turn, so each is looked at once.
    """
    measure(root)
    order = list(walk(root))
    own = {id(n): worth(n) for n in order}
    held = dict(own)
    said = {id(n): 0 if n.name == "a" else sum(len(c.strip()) for c in n.children if isinstance(c, str)) for n in order}
    told = dict(said)
    mains = {id(n) for n in order if n.name in ("article", "main")}
    for node in reversed(order):
        if node.parent is not None:
            held[id(node.parent)] += held[id(node)]
            told[id(node.parent)] += told[id(node)]
            if id(node) in mains:
                mains.add(id(node.parent))
    points, text, has_main, heap, turn = 0.0, 0, False, [], 0

    def open_up(top: Node) -> None:
        nonlocal points, text, has_main, turn
        stack = [top]
        while stack:
            node = stack.pop()
            points += own[id(node)]
            text += said[id(node)]
            has_main = has_main or node.name in ("article", "main") and told[id(node)] > 0
            for child in node.children:
                if isinstance(child, Node) and not child.out:
                    if child.suspect:
                        turn += 1
                        heapq.heappush(heap, (-held[id(child)], turn, child))
                    else:
                        stack.append(child)

    open_up(root)
    while heap:
        weight, _, node = heapq.heappop(heap)
        weight = -weight
        if node.suspect == 2:
            holds = text == 0
        elif id(node) in mains and not has_main:
            holds = weight >= points
        else:
            holds = weight > HOLDS * points and told[id(node)] > HOLDS * text and not has_main
        if weight > 0 and holds:
            open_up(node)
        else:
            node.out = True


def walk(node: Node) -> Iterator[Node]:
    """The wanted elements below a node, in page order, without recursion."""
    stack = [node]
    while stack:
        one = stack.pop()
        yield one
        stack.extend(c for c in reversed(one.children) if isinstance(c, Node) and not c.out)


def prose(node: Node) -> tuple[str, int]:
    """Text of a node, and how many of its characters are links."""
    parts, links = [], 0
    stack = [(node, False)]
    while stack:
        one, linked = stack.pop()
        if isinstance(one, str):
            text = _WHITE.sub(" ", entities.unescape(one))
            parts.append(text)
            links += len(text) if linked else 0
        elif not one.out:
            linked = linked or one.name == "a"
            stack.extend((c, linked) for c in reversed(one.children))
    return "".join(parts).strip(), links


def density(text: str, links: int) -> float:
    return min(1.0, links / len(text)) if text else 1.0


def measure(root: Node) -> None:
    """Characters, linked characters and commas of every wanted element, from the leaves up."""
    order = list(walk(root))
    for node in order:
        node.linked = node.chars = node.commas = 0
    for node in order:
        own = _WHITE.sub(" ", entities.unescape("".join(c for c in node.children if isinstance(c, str))))
        node.chars, node.commas = len(own), own.count(",") + own.count("、") + own.count("，")
        node.linked = len(own) if node.name == "a" else 0
    for node in reversed(order):
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.commas += node.commas
            up.linked += node.chars if up.name == "a" else node.linked


def points_of(chars: int, commas: int, linked: int) -> float:
    """The points of a paragraph, discounted by its link density."""
    return 0.0 if chars < LEAST_CHARS else (BASE_POINTS + commas + min(chars / PER_CHARS, MOST_FOR_LENGTH)) * (1 - min(1.0, linked / chars))


def worth(node: Node) -> float:
    """The points that an element itself gives: as a paragraph, or for its loose text."""
    if node.name in PARAGRAPHS:
        return points_of(node.chars, node.commas, node.linked)
    own = _WHITE.sub(" ", entities.unescape("".join(c for c in node.children if isinstance(c, str)))).strip()
    return points_of(len(own), own.count(",") + own.count("、") + own.count("，"), 0)


def score(root: Node) -> list[Node]:
    """Gives points to containers; returns them."""
    measure(root)
    held: dict[int, Node] = {}
    for node in walk(root):
        target, points, share = node.parent if node.name in PARAGRAPHS else node, worth(node), 1.0
        while points and target is not None and share >= 0.5:
            target.points += points * share
            held[id(target)] = target
            target, share = target.parent, share / 2
    for node in held.values():
        bonus = 1.25 if node.name in ("article", "main") else 1.0
        node.score = node.points * bonus * (1 - min(1.0, node.linked / max(1, node.chars)))
    return list(held.values())


def reads(text: str, links: int, heading: bool = False) -> bool:
    """Whether a text reads like prose: not mostly links, and long, or a sentence, or a heading."""
    return bool(text) and density(text, links) < MOST_LINKED and (heading or len(text) >= PROSE_CHARS or bool(_SENTENCE.search(text)))


def main_nodes(root: Node) -> list[Node]:
    """The best container, and what beside it belongs to the text: siblings that score near it or read like prose, and loose prose between."""
    held = score(root)
    if not held:
        return [root]
    best = max(held, key=lambda n: n.score)
    if best.parent is None:
        return [best]
    keep, loose = [], []

    def close() -> None:
        if loose:
            run = Node("div", None, False)
            run.children = loose[:]
            loose.clear()
            text, links = prose(run)
            if reads(text, links):
                keep.append(run)

    for node in best.parent.children:
        if isinstance(node, str) or node.name not in BLOCKS:
            loose.append(node)
            continue
        close()
        if node is best or not node.out and (node.score >= max(LEAST_SCORE, best.score * SIBLING_SHARE) or reads(*prose(node), node.name in HEADINGS)):
            keep.append(node)
    close()
    return keep


def blocks(nodes: list[Node]) -> list[str]:
    """Text blocks of nodes, in page order."""
    out, parts = [], []

    def close():
        text = _WHITE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            out.append(text)

    for top in nodes:
        close()
        stack: list = [top]
        while stack:
            one = stack.pop()
            if one is None:
                close()
            elif isinstance(one, str):
                parts.append(entities.unescape(one))
            elif not one.out:
                if one.name == "br":
                    parts.append(" ")
                elif one.name in BLOCKS or one.name == "#root":
                    close()
                    stack.append(None)
                stack.extend(reversed(one.children))
        close()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(main_nodes(tree(page)))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    set_arrow_batches(pages.sparkSession)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
