"""Main text of web pages: flat text blocks, judged by a decision tree.

A page is cut at block-level tags into a flat list of text blocks.  A block is described by its number of words, the share of them inside
links, the same of the block before and of the one after it, whether it is a heading or carries a copyright mark, and where it lies: in a boilerplate
container, outside the part that the page marks as its article, on a page that marks none, or inside that part.  A CART tree, fitted
on the blocks of the labelled layouts below, decides which blocks belong to the article; these are joined in page order.

The page is not parsed into a tree.  One pass over its tags keeps the open containers and what they inherit, closes paragraphs and list items as browsers
do, and ignores closing tags that match nothing, so the cost grows with the page alone, whatever its nesting.

Null or empty pages have an empty text, as have pages without article blocks.  Cut-off pages end where they end: an unfinished tag or comment is no text, an unclosed
script runs to the end.  Very long pages are read whole, repeated pages alike, an empty table gives no rows.  The result is a column expression, so names of other columns cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import wide_rows

# fixed values: elements whose content is never text of the page
SKIPPED = "script style noscript template title textarea select button svg canvas iframe object audio video math datalist".split()
RAW = {"script", "style", "title", "textarea"}  # run to the page's end where they are not closed
# fixed values: elements that end a block
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"hr"}
# fixed values: an open element (left) that the start of another one (right) closes
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "tr": {"tr", "tbody"}, "option": {"option", "optgroup"}}
# fixed values: elements and roles that hold boilerplate, whatever lies in them
STRONG = {"nav", "aside", "footer", "dialog", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
WEAK = {"form", "header", "fieldset"}  # unless an article or main lies in them
# fixed values: words of class and id names; those of READERS are of reader comments
READERS = re.compile(r"comment|repl(?:y|ies)$|respond$|discussion|disqus")
NAMES = re.compile(
    r"^(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|\w*menu|menu\w*|\w*sidebar\w*|side|aside|rail|\w*footer\w*|foot|header|masthead|topbar|toolbar|breadcrumb\w*|pag(?:er|ination)|"
    r"cookie\w*|consent\w*|gdpr|privacy|notices?|notification\w*|alerts?|popup|modal|overlay|newsletter\w*|subscri\w*|signup|signin|login|search\w*|share|sharing|social\w*|related\w*|recommend\w*|widgets?|copyright|legal|form|skip)$"
)
CORE = re.compile(r"^(?:article\w*|post|entry|story|content|main|maincontent|maintext|bodytext|blogpost|hentry)$")
APART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in SKIPPED}

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "zone", "heading", "copyright"]
ZONES = {"boilerplate": -1, "outside": 0, "unmarked": 1, "article": 2}

# Labelled layouts: {+n} are n words of the article, {-n} n words of something else.  Words themselves play no part.
LABELLED = """
<nav><ul><li><a href=x>{-1}</a></li><li><a href=x>{-1}</a></li><li><a href=x>{-2}</a></li></ul></nav><div class="ad">{-9}</div><article><h1>{+7}</h1><p>{+45}</p><p>{+1}</p><p>{+80}</p><p>{+12}</p></article><footer>&copy; {-14}</footer>
<header><div>{-3}</div></header><article><h1>{+4}</h1><p>{+3}</p><p>{+2}<p>{+28}<p><a href=x>{+6}</a></p><p>{+30} <a href=x>{+9}</a></p><aside>{-25}</aside><p>{+55}</p><ul><li>{+5}</li><li>{+3}</li></ul></article><div>{-40}</div>
<div class="cookie-notice">{-30} <a href=x>{-2}</a></div><div id="top-menu"><a href=x>{-1}</a> <a href=x>{-1}</a> <a href=x>{-1}</a></div><main><h1>{+9}</h1><p>{+60}</p><blockquote>{+22}</blockquote><p>{+8}</p><div class="ad-box">{-18}</div><p>{+35}</p></main><section id="comments"><h2>{-2}</h2><div class="comment"><p>{-33}</p></div><div class="comment"><p>{-4}</p></div></section>
<div class="header">{-5}</div><div class="content"><h1>{+6}</h1><p>{+70}</p><h2>{+2}</h2><p>{+52}</p><table><tr><td>{+2}</td><td>{+1}</td></tr></table><p>{+15}</p></div><div class="sidebar"><h3>{-2}</h3><p>{-31}</p><ul><li><a href=x>{-5}</a></li><li><a href=x>{-6}</a></li></ul></div><div class="footer">{-12}</div>
<div><a href=x>{-1}</a> <a href=x>{-1}</a> <a href=x>{-1}</a> <a href=x>{-2}</a></div><h1>{+8}</h1><div>{+66}</div><div>{+40}</div><div>{+9}</div><div>{+51}</div><div>&copy; {-8}</div>
<ul><li><a href=x>{-2}</a></li><li><a href=x>{-1}</a></li><li><a href=x>{-1}</a></li></ul><h1>{+5}</h1><p>{+30}</p><p>{+4}</p><p>{+75}</p><h2>{+3}</h2><p>{+21}</p><ul><li><a href=x>{-4}</a></li><li><a href=x>{-7}</a></li><li><a href=x>{-5}</a></li></ul><p>&copy; {-4}</p>
<table><tr><td><a href=x>{-2}</a><br><a href=x>{-2}</a><br><a href=x>{-1}</a></td><td><h2>{+6}</h2><p>{+90}</p><p>{+17}</p><p>{+44} <a href=x>{+3}</a> {+8}</p></td></tr></table><p><a href=x>{-2}</a> | <a href=x>{-1}</a></p>
<article><h1>{+11}</h1><p>{+19}</p><form>{-4} {-2}</form><p>{+64}</p><footer>{-7}</footer></article><div class="newsletter"><p>{-20}</p></div><div>{-60}</div><article class="related"><h3><a href=x>{-6}</a></h3><p>{-12}</p></article>
<div class="post"><h2>{+5}</h2><div class="share"><a href=x>{-1}</a> <a href=x>{-1}</a></div><p>{+38}</p><p>{+2}</p><p>{+110}</p><ol class="commentlist"><li>{-44}</li><li>{-3}</li></ol></div><div>{-9}</div>
<p>{+120}</p>
<p>{+14}</p><p>{+26}</p><p>{+33}</p>
<div>{-3}</div><p><a href=x>{-3}</a></p><p><a href=x>{-4}</a></p><p><a href=x>{-2}</a></p><p>{+48}</p><p>{+57}</p><p>{+6}</p><p>{+83}</p><div><a href=x>{-2}</a> <a href=x>{-3}</a></div><div>&copy; {-6}</div>
<main><article><h1>{+6}</h1><p>{+5} <a href=x>{+12}</a></p><p>{+2}</p><figure><figcaption>{+8}</figcaption></figure><p>{+47}</p><dl><dt>{+1}</dt><dd>{+6}</dd></dl></article><section><h2>{-2}</h2><p>{-16}</p></section></main><nav><a href=x>{-2}</a></nav>
<div role="banner">{-4}</div><div id="main-content"><h1>{+3}</h1><p>{+23}</p><p><a href=x>{+4}</a></p><p>{+71}</p><div role="navigation"><a href=x>{-1}</a></div><p>{+1}</p></div><div id="bottom">{-35}</div>
<div><a href=x>{-3}</a></div><h1>{+6}</h1><p>{+64}</p><p>{+31}</p><div><a href=x>{-2}</a></div><div><a href=x>{-2}</a></div><div>{-2}</div>
<article><h2>{+4}</h2><ul><li><a href=x>{+3}</a></li><li><a href=x>{+5}</a></li><li><a href=x>{+2}</a></li></ul><p>{+9}</p><p><a href=x>{+7}</a></p><p>{+3}</p></article><p>{-50}</p>
<div>{-2}</div><div><a href=x>{-1}</a> <a href=x>{-1}</a></div><div>{-4}</div><h1>{+9}</h1><p>{+41}</p><p>{+3}</p><p>{+29}</p><p>{+77}</p><div><a href=x>{-3}</a></div><div>{-3}</div><div><a href=x>{-2}</a></div><div>{-5}</div>
<td><a href=x>{-4}</a><td>{-3}<td><a href=x>{-6}</a><td>{-2}<td><a href=x>{-5}</a><h2>{+7}</h2><p>{+36}</p><p>{+5}</p><p>{+5}</p><p>{+48}</p><td><a href=x>{-5}</a><td>{-4}<td><a href=x>{-3}</a>
<p><a href=x>{-2}</a></p><p>{-6}</p><h1>{+3}</h1><p>{+2}</p><p>{+58}</p><p>{+22} <a href=x>{+6}</a></p><h3>{+2}</h3><p>{+90}</p><p>{+7}</p><p>{+34}</p><p>{-4}</p><p><a href=x>{-4}</a></p>
""".strip().splitlines()


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    boilerplate: bool
    grade: int  # 3: in an article element, 2: in main, 1: in a container named so, 0: none


def _hints(name: str, attrs: str) -> tuple[bool, bool, int]:
    """(boilerplate whatever lies in it, boilerplate, grade of an article) of an element by itself."""
    strong, weak, grade = name in STRONG, name in WEAK, {"article": 3, "main": 2}.get(name, 0)
    if attrs and "=" in attrs and name not in ("html", "body"):
        for what, a, b, c in ATTR.findall(attrs):
            value, what = a or b or c, what.lower()
            if what == "role":
                strong |= value.lower() in ROLES
                grade = max(grade, {"article": 3, "main": 2}.get(value.lower(), 0))
            elif what == "itemprop":
                grade = max(grade, 3 * (value.lower() == "articlebody"))
            else:
                for one in value.split():
                    parts = [p.lower() for p in APART.split(one) if p]
                    if any(p in ("has", "with", "no", "without", "is", "not") for p in parts[:-1]):
                        continue  # says something of the page, like has-sidebar
                    core = any(CORE.match(p) for p in parts)
                    strong |= any(READERS.search(p) for p in parts) and grade < 2
                    named = any(NAMES.match(p) and not (core and p == "header") for p in parts)
                    weak |= named
                    if core and not named:
                        grade = max(grade, 1)
    return strong, weak, grade


def cut_blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    # open containers: name, boilerplate for good, boilerplate, grade; the first holds the page
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
    names: Counter[str] = Counter()
    pieces: list[str] = []
    linked, link = 0, -1  # words inside links so far; depth at which a link was opened

    def add(text: str) -> None:
        nonlocal linked
        text = entities.unescape(text) if "&" in text else text
        pieces.append(text)
        if link >= 0:
            linked += max(len(text.split()), len(text) // 8)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            words = max(len(text.split()), len(text) // 8)
            _, strong, weak, grade = stack[-1]
            out.append(Block(text, words, min(linked, words), any(names[h] for h in HEADINGS), strong or weak, grade))
        pieces.clear()
        linked = 0

    def pop() -> None:
        names[stack.pop()[0]] -= 1

    at = 0
    while found := TAG.search(page, at):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(found[1])
        if name in ENDS:
            if not closing:
                end = ENDS[name].search(page, at)
                if end:
                    at = end.end()
                elif name in RAW:
                    at = len(page)
        elif name == "br":
            pieces.append(" ")
        elif name == "a":
            link = len(stack) if not closing and "href" in found[3].lower() else -1
        elif name in BLOCKS:
            flush()
            if closing:
                if names[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
            else:
                if names["p"] and name in CLOSES["p"]:
                    while stack[-1][0] != "p":
                        pop()
                    pop()
                while stack[-1][0] != "p" and name in CLOSES.get(stack[-1][0], ()):
                    pop()
                if name not in VOID:
                    _, strong, weak, grade = stack[-1]
                    own_strong, own_weak, own = _hints(name, found[3])
                    if name == "header" and grade >= 2:
                        own_weak = False  # an article's own heading
                    strong |= own_strong
                    weak = own_weak or (weak and own < 2)
                    names[name] += 1
                    stack.append((name, strong, weak, max(grade, own)))
            if link > len(stack):
                link = -1  # a link that was never closed ends with its container
    if at < len(page):
        add(page[at:])
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of a page."""
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.linked for b in blocks], float) / words
    fine = np.array([not b.boilerplate for b in blocks])
    grade = np.array([b.grade for b in blocks])
    # the narrowest kind of container that holds at least half of the words that any article container holds
    inside = [words[fine & (grade >= g)].sum() for g in range(4)]
    core = max((g for g in (1, 2, 3) if inside[g] and inside[g] * 2 >= inside[1]), default=0)
    zone = np.where(~fine, ZONES["boilerplate"], np.where(grade >= core, ZONES["article"], ZONES["outside"]) if core else ZONES["unmarked"])
    before, after = (lambda v: np.concatenate([[0.0], v[:-1]])), (lambda v: np.concatenate([v[1:], [0.0]]))
    mark = [b.text[:1] == "©" or b.text[:9].lower() == "copyright" for b in blocks]
    return np.column_stack([words, links, before(words), before(links), after(words), after(links), zone, [b.heading for b in blocks], mark]).astype(float)


@dataclass(frozen=True)
class Tree:
    """A node: rows with feature `at` of `cut` or less go low; a leaf has no `low`."""

    main: bool
    at: int = 0
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def judge(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.main)
        goes = x[:, self.at] <= self.cut
        out = np.empty(len(x), bool)
        out[goes], out[~goes] = self.low.judge(x[goes]), self.high.judge(x[~goes])
        return out


def fit_tree(x: np.ndarray, y: np.ndarray, deep: int = 6, leaf: int = 2) -> Tree:
    """CART with Gini impurity; ties go to the earlier feature and the lower cut."""
    main = bool(y.mean() >= 0.5)
    if deep == 0 or y.all() or not y.any():
        return Tree(main)
    best = None
    for at in range(x.shape[1]):
        values = np.unique(x[:, at])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, at] <= cut
            n = low.sum()
            if min(n, len(y) - n) < leaf:
                continue
            p, q = y[low].mean(), y[~low].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, at, cut, low)
    if best is None or best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-12:
        return Tree(main)
    _, at, cut, goes = best
    low, high = fit_tree(x[goes], y[goes], deep - 1, leaf), fit_tree(x[~goes], y[~goes], deep - 1, leaf)
    if low.low is None and high.low is None and low.main == high.main:
        return Tree(main)  # the cut changes no verdict
    return Tree(main, at, float(cut), low, high)


def labelled_rows(layouts: list[str] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (True: article) of all blocks of the labelled layouts."""
    x, y = [], []
    for layout in layouts:
        page = re.sub(r"\{([+-])(\d+)\}", lambda m: " ".join([f"{m[1]}word"] * int(m[2])), layout)
        blocks = cut_blocks(page)
        x.append(features(blocks))
        y += ["+" in b.text for b in blocks]
    return np.concatenate(x), np.array(y)


@cache
def default_tree() -> Tree:
    return fit_tree(*labelled_rows())


def main_text(page: str | None, tree: Tree | None = None) -> str:
    blocks = cut_blocks(page or "")
    keep = (tree or default_tree()).judge(features(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(html: Column | str, spark: SparkSession, tree: Tree | None = None) -> Column:
    """The main text of pages, as a column expression."""
    wide_rows(spark)
    tree = tree or default_tree()

    @F.pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return extracted(F.col(html) if isinstance(html, str) else html)


def page_blocks(pages: DataFrame, key: str, html: str, tree: Tree | None = None) -> DataFrame:
    """key, at, text, main and FEATURES: every block of every page and the tree's verdict, for looking into a corpus or labelling more."""
    wide_rows(pages.sparkSession)
    tree = tree or default_tree()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, page in zip(b["key"], b["html"], strict=True):
                blocks = cut_blocks(page or "")
                x = features(blocks)
                if blocks:
                    yield pd.DataFrame({"key": [k] * len(blocks), "at": range(len(blocks)), "text": [b.text for b in blocks], "main": tree.judge(x)} | {f: x[:, i] for i, f in enumerate(FEATURES)})

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(each, f"key {kind}, at int, text string, main boolean, " + ", ".join(f"{f} double" for f in FEATURES))
    return out.withColumnRenamed("key", key)
