"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. Each block has its word count and link density, those of its two neighbours on
either side, its place in the page and the page's number of blocks: the FLAT features, which alone may decide in the top FIRST levels of the tree. Below them it may also ask
what a block's place in the markup says (inside navigation, header, footer, aside or form; inside article or main; a class or id that
names boilerplate or content; heading) and what its page has of content elements. The tree is trained once, on the driver, on a small labelled table, pages
that rules build here from a fixed seed, and keeps the blocks of the article. Scripts, styles, comments and the head never become blocks. Of an svg its text elements are read; math is
text but for its annotations.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page order by two
newlines. Defined cases: null and empty html give an empty text with 0 characters; html without tags is one block; a tag without its end ends before the
next "<", and comments and scripts run to the end of what holds them. Rows are extracted one by one, repeated rows alike; other columns are not read.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacorn.llm.common import arrow_schema, batch, slices

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long"
#: Elements whose content is no text; elements that begin a block; elements that the features name; words of a class or id.
HIDDEN = "script style noscript template svg iframe object canvas annotation-xml annotation audio video head"
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "input legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MENUS, FORMS, BODIES, HEADINGS = {"nav", "menu"}, {"form", "button", "select", "option", "textarea", "fieldset", "legend", "dialog"}, {"article", "main"}, {"h1", "h2", "h3", "h4", "h5", "h6"}
BAD_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay sidebar side rail related "
    "recommended share sharing social comment comments reply replies respond disqus nav navbar navigation menu breadcrumb breadcrumbs footer header masthead toolbar widget newsletter subscribe "
    "subscription signup login search copyright legal pagination pager tags tagcloud meta byline skip".split()
)
GOOD_WORDS = set("article content post entry story body text main prose".split())
#: Attributes up to a tag's end or the next tag; those of a tag that ends itself; where a tag ends, though its ">" be missing.
ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
SELF = r"""(?:[^<>"'/]|/(?!>)|"[^"]*"|'[^']*')*+/>"""
END = r"(?:>|(?=<)|\Z)"
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?:svg|annotation-xml|annotation)\b{SELF}"""
    rf"""|<(script|style|noscript|template|svg|iframe|object|canvas|annotation-xml|annotation|audio|video|head)\b{ATTRIBUTES}>.*?(?:</\1\s*>|(?=<body\b)|\Z)"""
    rf"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({ATTRIBUTES}){END}|<[!?/][^<>]*{END}""",
    re.S | re.I,
)
SVG_TEXT = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?:script|style|title|desc|metadata|text|foreignObject)\b{SELF}|<(script|style|title|desc|metadata)\b{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"""
    rf"""|<(text|foreignObject)\b{ATTRIBUTES}>(.*?)(?:</\2\s*>|\Z)""",
    re.S | re.I,
)
TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|title|desc)\b{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<[^<>]*{END}""", re.S | re.I)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Depth of the tree, its top levels that ask flat features alone, and its smallest leaf.
DEPTH, FIRST, LEAF, SEED = 9, 3, 4, 11
FLAT = "words density words_before density_before words_after density_after words_before_2 density_before_2 words_after_2 density_after_2 position blocks_on_page".split()
FEATURES = FLAT + "menu header footer aside form body bad good heading item paragraph body_on_page good_on_page outside".split()


PLACES = FEATURES[len(FLAT) : len(FLAT) + 11]


@dataclass
class Block:
    text: str
    words: int
    density: float
    place: tuple


def _words_of(attributes: str) -> set[str]:
    return {w.lower() for m in NAMED.finditer(attributes) for w in NAME_WORD.findall(m[1] or m[2] or m[3] or "")} if "=" in attributes else set()


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page with words."""
    out: list[Block] = []
    held: list[str] = []
    linked = [0, 0]  # link depth, linked words
    stack: list[tuple[str, frozenset]] = [("", frozenset())]
    opened: Counter[str] = Counter()

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            words = text.count(" ") + 1
            flags = stack[-1][1]
            out.append(Block(text, words, min(1.0, linked[1] / words), tuple(f in flags for f in PLACES)))
        held.clear()
        linked[1] = 0

    def add(piece: str) -> None:
        if piece:
            held.append(piece)
            if linked[0]:
                linked[1] += len(html.unescape(piece).split())

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1] and m[1].lower() == "svg":
                for shown in SVG_TEXT.finditer(m[0]):
                    if shown[3]:
                        add(" " + TAG.sub("" if shown[2].lower() == "text" else " ", shown[3]) + " ")
            continue
        name = name.lower()
        if name == "a":
            linked[0] = 0 if m[2] else 1
        elif name == "br":
            held.append(" ")
        elif name in BLOCKS:
            close()
            if m[2]:
                if opened[name]:
                    while (last := stack.pop()[0]) != name:
                        opened[last] -= 1
                    opened[name] -= 1
                continue
            if name in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and len(stack) > 1 and stack[-1][0] == name or stack[-1][0] == "p":
                opened[stack.pop()[0]] -= 1  # its end tag may be left out
            if name in VOID:
                continue
            stack.append((name, stack[-1][1] | _flags(name, m[4], stack[-1][1])))
            opened[name] += 1
    add(page[at:])
    close()
    return out


def _flags(name: str, attributes: str, above: frozenset) -> set[str]:
    out = set()
    words = _words_of(attributes)
    if name in MENUS:
        out.add("menu")
    elif name == "header" and "body" not in above:
        out.add("header")
    elif name in ("footer", "aside"):
        out.add(name)
    elif name in FORMS:
        out.add("form")
    elif name in BODIES:
        out.add("body")
    elif name in HEADINGS:
        out.add("heading")
    elif name == "li":
        out.add("item")
    elif name == "p":
        out.add("paragraph")
    if words & BAD_WORDS and name not in ("html", "body"):
        out.add("bad")
    elif words & GOOD_WORDS:
        out.add("good")
    return out


def features(found: list[Block]) -> np.ndarray:
    """Rows of FEATURES."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words, density = np.array([b.words for b in found], float), np.array([b.density for b in found])
    place = np.array([b.place for b in found], float)
    n = len(found)
    before = lambda v, k: np.concatenate([np.zeros(k), v])[:n]
    after = lambda v, k: np.concatenate([v[k:], np.zeros(k)])[:n]
    near = [f(v, k) for k in (1, 2) for f in (before, after) for v in (words, density)]
    inside = np.maximum(place[:, PLACES.index("body")], place[:, PLACES.index("good")])
    outside = (inside < inside.max()).astype(float)  # the page has content elements, and the block is in none
    page = [place[:, PLACES.index("body")].max(), place[:, PLACES.index("good")].max()]
    return np.column_stack([words, density, *near, np.arange(n) / max(1, n - 1), np.full(n, n), place, np.tile(page, (n, 1)), outside])


def labelled_pages(n: int, seed: int) -> list[list[tuple[str, int]]]:
    """n pages as (markup, label) in page order, label 1 for article blocks: the small labelled table, over usual ways to mark pages up."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + i) for i in rng.integers(0, 26, int(rng.integers(2, 10))))
    prose = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b)))) + "."
    link = lambda k: f'<a href="/{word()}">{" ".join(word() for _ in range(k))}</a>'
    some = lambda *options: options[int(rng.integers(len(options)))]
    chance = lambda p: rng.random() < p
    pages = []
    for _ in range(n):
        if chance(0.08):  # a page of nothing but its text
            pages.append([(some("<p>{}</p>", "{}", "<div>{}</div>", "<pre>{}</pre>").format(prose(2, 80)), 1) for _ in range(int(rng.integers(1, 4)))])
            continue
        page = [(some('<header class="site-header">{}</header>', '<div id="header">{}</div>', "<header>{}</header>").format(prose(1, 8)), 0)] if chance(0.5) else []
        menu = some(("<nav><ul>", "</ul></nav>"), ('<div class="menu"><ul>', "</ul></div>"), ("<ul>", "</ul>"))
        if chance(0.7):
            page += [(menu[0], 0), *((f"<li>{link(int(rng.integers(1, 3)))}</li>", 0) for _ in range(int(rng.integers(1, 9)))), (menu[1], 0)]
        notices = ['<div class="cookie-notice">{}</div>', '<div class="ad">{}</div>', '<div class="alert banner">{}</div>', '<aside class="promo">{}</aside>', '<div id="ad-top">{}</div>', '<div class="advert">{}</div>']
        page += [(some(*notices).format(prose(2, 30)), 0) for _ in range(int(rng.integers(0, 3)))]
        style = some(("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="content">', "</div>"), ("<article>", "</article>"), ("<div>", "</div>"))
        article = [(f"<h1>{prose(1, 14)}</h1>", 1)] if chance(0.9) else []
        for _ in range(int(rng.integers(0, 9))):
            article.append(some((f"<p>{prose(1, 120)}</p>", 1), (f"<p>{prose(10, 60)} {link(2)} {prose(5, 40)}</p>", 1), (f"<p><b>{prose(3, 50)}<br>", 1), (f"<h2>{prose(1, 6)}</h2>", 1), (f"<blockquote>{prose(5, 40)}</blockquote>", 1), (f"<ul><li>{prose(2, 15)}</li></ul>", 1)))
            if chance(0.12):
                article.append((some(*notices).format(prose(2, 25)), 0))
        outside = lambda: [(some("<div>{}</div>", "<p>{}</p>", "<section>{}</section>").format(prose(2, 60)), 0)] if style[0] in ("<article>", "<main>") and chance(0.3) else []
        page += [*outside(), (style[0], 0), *article, (style[1], 0), *outside()]
        if chance(0.4):
            page.append((some('<aside class="sidebar">{}</aside>', '<div class="sidebar">{}</div>', '<div class="related">{}</div>').format(f"<h3>{prose(1, 4)}</h3><ul>" + "".join(f"<li>{link(4)}</li>" for _ in range(4)) + f"</ul><p>{prose(3, 20)}</p>"), 0))
        if chance(0.4):
            page.append((some('<section class="comments">{}</section>', '<div id="comments">{}</div>').format("".join(f'<div class="comment"><p>{prose(3, 60)}</p></div>' for _ in range(int(rng.integers(1, 5))))), 0))
        if chance(0.3):
            page.append((f'<form action="/s"><label>{prose(1, 5)}</label><button>{word()}</button></form>', 0))
        if chance(0.3):
            pages.append(page)
            continue
        page.append((some("<footer>{}</footer>", '<div class="footer">{}</div>').format(f"&copy; {word()}.example &middot; {prose(2, 20)} {link(1) if chance(0.5) else ''}"), 0))
        pages.append(page)
    return pages


def labelled_table(n: int = 250, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages; a mark in the text carries the label through the parser."""
    x, y = [], []
    for page in labelled_pages(n, seed):
        marked = "".join(re.sub(r"(>|^)([^<>]*\w[^<>]*)", lambda m, label=label: f"{m[1]}{m[2]}\x02{label}", markup) for markup, label in page)
        found = blocks(f"<html><body>{marked}</body></html>")
        labels = [int(m[1]) if (m := re.search("\x02([01])", b.text)) else 0 for b in found]
        x.append(features(found))
        y += labels
    return np.concatenate(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, first: int = FIRST) -> tuple:
    """A tree: (share of label 1,) or (feature, cut, below or at it, above it), by Gini impurity; first: levels yet to come that ask flat features alone."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * LEAF:
        return (share,)
    best = None
    for f in range(len(FLAT) if first > 0 else x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (k >= LEAF) & (len(y) - k >= LEAF)
        if not ok.any():
            continue
        p, q = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(y) - k)
        cost = np.where(ok, k * p * (1 - p) + (len(y) - k) * q * (1 - q), np.inf)
        at = int(cost.argmin())
        if best is None or cost[at] < best[0] - 1e-12:
            best = (cost[at], f, (v[at] + v[at + 1]) / 2)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return (share,) if first <= 0 else grow(x, y, depth - first, 0)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1, first - 1), grow(x[~left], y[~left], depth - 1, first - 1)


@functools.lru_cache(maxsize=1)
def tree() -> tuple:
    """The tree of the labelled table, for the driver to train and send."""
    return grow(*labelled_table())


def decide(x: np.ndarray, node: tuple) -> np.ndarray:
    """The share of label 1 at each row's leaf."""
    if len(node) == 1:
        return np.full(len(x), node[0])
    out, left = np.zeros(len(x)), x[:, node[0]] <= node[1]
    out[left], out[~left] = decide(x[left], node[2]), decide(x[~left], node[3])
    return out


def extract_all(pages: list, root: tuple | None = None) -> list[tuple[str, int]]:
    """(main text, number of its blocks) of each page."""
    found = [blocks(p) if p else [] for p in pages]
    kept = decide(np.concatenate([np.zeros((0, len(FEATURES))), *map(features, found)]), root or tree()) >= 0.5
    out, at = [], 0
    for page in found:
        mine = [b.text for b, keep in zip(page, kept[at : at + len(page)]) if keep]
        at += len(page)
        out.append(("\n\n".join(mine), len(mine)))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """A row for each row of pages (page_id, url, html): page_id, url, text, n_chars, n_blocks."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    root = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = extract_all(part.column("html").to_pylist(), root)
            yield batch(arrow_schema(SCHEMA), part.column("page_id"), part.column("url"), [t for t, _ in texts], [len(t) for t, _ in texts], [n for _, n in texts])

    return narrow.mapInArrow(run, SCHEMA)
