from html.parser import HTMLParser

import numpy as np
import pytest

from lattica.llm import htmltext as H
from lattica.llm import queries as Q

BODY = "The first paragraph of the story runs on for quite a while, so that nobody could take it for a menu. " * 2
MORE = "A second one follows, which is long enough as well and says a few more things about the same matter. " * 2


def squeeze(*parts):
    return " ".join(" ".join(p.split()) for p in parts)


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{BODY}<p>Yes.<p>{MORE}</article><footer>&copy; me</footer>", ["Title", BODY, "Yes.", MORE]),
        (f"<body class='has-sidebar'><div id=header>Site name</div><div class=content><h1>Title</h1><p>{BODY}</p><p>No.</p><p>{MORE}</p></div><div class='sidebar-left'>{MORE}</div>", ["Title", BODY, "No.", MORE]),
        (f"<main><h1>Title</h1><p>{BODY}</p><div class='cookieBanner'>We use cookies {MORE}</div><p>{MORE}</p><section id='comments'><article class='comment'><p>{BODY}</p></article></section></main>", ["Title", BODY, MORE]),
        (f"<form action=x><div class=menu><a href=/>a</a></div><article><header><h1>Title</h1></header><p>{BODY}</p><form>Your mail <input> <button>Send</button></form><p>{MORE}</p></article></form>", ["Title", BODY, MORE]),
        (f"<div><a href=1>One</a> <a href=2>Two</a></div><h1>A title of five words</h1><div>{BODY}</div><div>{MORE}</div><div><a href=3>Three</a></div><div>&copy; 2024 someone</div>", ["A title of five words", BODY, MORE]),
        (f"<article><p>{BODY}</p><aside><article>{MORE}</article></aside><p>{MORE}</p></article><article class='related-posts'><p>{BODY}</p></article>", [BODY, MORE]),
        (f"<div class='ad'>Buy this now</div>{BODY}", [BODY]),
    ],
)
def test_layouts(page, want):
    assert H.main_text(page) == squeeze(*want)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>one<br>two <b>th</b>ree</p>", "one two three"),
        ("<p>a &lt;b&gt; &amp;amp; &#233;&nbsp;&hellip;</p>", "a <b> &amp; é …"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<script>var t = '</p><p>no</p>';</script><style>p{}</style><p>yes<!-- <p>no</p> --> yes</p>", "yes yes"),
        ("<p title='a > b'>text</p><p data-x=\"it's\">more</p>", "text more"),
        ("<p>cut &am", "cut &am"),
        ("<p>cut <a hre", "cut"),
        ("<p>cut<!-- never closed <p>no", "cut"),
        ("<p>cut<script>never closed <p>no", "cut"),
        ("<P>Upper</P><SCRIPT>no</SCRIPT><P>case</P>", "Upper case"),
        ("</div></p></article><p>stray ends</p></div>", "stray ends"),
        ("<article><select><option>no</option></select>yes<noscript>no</noscript></article>", "yes"),
        ("plain text\n without  tags", "plain text without tags"),
        ("", ""), (None, ""), ("<html></html>", ""), ("<<<>>>", "<<<>>>"),
    ],
)
def test_markup(page, want):
    assert H.main_text(page) == want


class Article(HTMLParser):
    """The text of an article element, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.inside = [], False

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in H.BLOCKS or tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in H.BLOCKS:
            self.text.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.text.append(data)


def test_query(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = Q.op13_html(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        plain = Article()
        plain.feed(pages[r["page_id"]]["html"])
        plain.close()
        assert r["text"] == squeeze("".join(plain.text)) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_edge_rows(spark, tmp_path):
    rows = [(1, "u", None, 3, "x"), (2, None, "", 3, "x"), (None, "u", "<p>a</p>", 3, "x"), (3, "u", "<article>" + "<p>word 🙂</p>" * 50_000, 3, "x"), (4, "u", "<div>" * 30_000 + "deep" + "</div></b>" * 30_000, 3, "x"), (1, "u", None, 3, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, Q.op13_html(spark, str(tmp_path)).collect()), key=str)
    whole = " ".join(["word 🙂"] * 50_000)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0), (None, "u", "a", 1), (3, "u", whole, len(whole)), (4, "u", "deep", 4)], key=str)
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert Q.op13_html(spark, str(tmp_path)).count() == 0


def test_blocks(spark):
    df = spark.createDataFrame([(7, "<nav><a href=x>Home page</a></nav><article><h1>Title</h1><p>Three words here</p></article>"), (8, None)], "page_id long, html string")
    got = [(r["page_id"], r["at"], r["text"], r["main"], r["words"], r["links"], r["words_after"], r["zone"]) for r in H.page_blocks(df, "page_id", "html").orderBy("at").collect()]
    assert got == [(7, 0, "Home page", False, 2.0, 1.0, 1.0, -1.0), (7, 1, "Title", True, 1.0, 0.0, 3.0, 2.0), (7, 2, "Three words here", True, 3.0, 0.0, 0.0, 2.0)]


def all_cuts(x, y, deep, leaf):
    """The same tree rules in plain loops: (verdict) or (feature, cut, low, high)."""
    gini = lambda v: len(v) * (sum(v) / len(v)) * (1 - sum(v) / len(v))
    main = 2 * sum(y) >= len(y)
    best = (gini(y) - 1e-9, None)
    if deep and 0 < sum(y) < len(y):
        for f in range(len(x[0])):
            values = sorted({r[f] for r in x})
            for a, b in zip(values, values[1:], strict=False):
                low, high = [v for r, v in zip(x, y, strict=True) if r[f] <= (a + b) / 2], [v for r, v in zip(x, y, strict=True) if r[f] > (a + b) / 2]
                if min(len(low), len(high)) >= leaf and gini(low) + gini(high) < best[0] - 1e-9:
                    best = (gini(low) + gini(high), (f, (a + b) / 2))
    if not best[1]:
        return main
    f, cut = best[1]
    low, high = (all_cuts([r for r in x if (r[f] <= cut) == side], [v for r, v in zip(x, y, strict=True) if (r[f] <= cut) == side], deep - 1, leaf) for side in (True, False))
    return main if low is high else (f, cut, low, high)


def shape(t):
    return t.main if t.low is None else (t.at, t.cut, shape(t.low), shape(t.high))


@pytest.mark.parametrize("seed", range(3))
def test_tree_against_plain_loops(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] > 5) ^ (rng.random(60) < 0.1)
    assert shape(H.fit_tree(x, y, 4, 3)) == all_cuts(x.tolist(), y.tolist(), 4, 3)


def test_labelled_layouts_are_learned():
    x, y = H.labelled_rows()
    assert (H.default_tree().judge(x) == y).mean() > 0.98
    # left out one at a time, most blocks of the layout are still judged right
    right = []
    for i in range(len(H.LABELLED)):
        tree = H.fit_tree(*H.labelled_rows(H.LABELLED[:i] + H.LABELLED[i + 1 :]))
        x, y = H.labelled_rows([H.LABELLED[i]])
        right += list(tree.judge(x) == y)
    assert np.mean(right) > 0.85
