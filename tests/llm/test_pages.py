"""Main text of pages: the reading of HTML, the chain against sums over all labellings, held-out pages, and whole layouts."""

import itertools
import re
from html import unescape
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.llm import pages
from seqframe.llm.labelled import MAIN, labelled_pages

SF = "/root/testdata/sf0.001"


def texts(html):
    return [t for _, t in pages.Page(html).blocks]


@pytest.mark.parametrize(
    "html,blocks",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b<b>c</b>d<br>e</p> f", ["a", "bcd e", "f"]),
        ("<title>no</title><style>p{}</style><script>var t='</p>';</script><p>yes", ["yes"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
        ("a<!-- <p>x</p> -->b <!-- open", ["ab"]),
        ("<p title='>' class=\"x>y\">a</p><p title='odd>b</p>", ["a", "b"]),
        ("1 < 2 <3 & &lt;p&gt; &nbsp;&#233;&copy <p>x</p> cut &am", ["1 < 2 <3 & <p> é©", "x", "cut &am"]),
        ("<p>a</p><p cl", ["a"]),
        ("<p>a</p><script>never closed <p>b", ["a"]),
        ("<select><option>x</select><button>y</button><noscript>z</noscript><svg><text>t</text></svg>a", ["a"]),
        ("<div>a<div>b</div>c</div></div></p>d", ["a", "b", "c", "d"]),
        ("<div/>a<br/>b<img src=x/>c", ["a bc"]),
        ("<b><div>a</b>b</div>c", ["ab", "c"]),
    ],
)
def test_leaf_blocks(html, blocks):
    assert texts(html) == blocks


def test_deep_and_long_pages_stay_linear():
    assert texts("<div>" * 50_000 + "x" + "</div>" * 50_000 + "y") == ["x", "y"]
    assert len(texts("<li><b><p>x" * 30_000)) == 30_000
    assert texts("<a<" * 50_000) == []


def test_zones():
    assert pages.zones_of("div", ' class="site-header"') == ("head",)
    assert pages.zones_of("aside", " id=adBox hidden") == ("side", "ad", "notice")
    assert pages.zones_of("div", ' style="display: none"') == ("notice",)
    assert pages.zones_of("div", ' data-class="nav" class="address"') == ()


def brute(scores, pairs, first):
    every = {}
    for labels in itertools.product((0, 1), repeat=len(scores)):
        total = sum(s * y for s, y in zip(scores, labels)) + first * labels[0]
        every[labels] = total + sum(pairs[a][b] for a, b in zip(labels, labels[1:]))
    return every


def test_chain_equals_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    pairs, first = rng.normal(size=(2, 2)), 0.3
    lengths = [1, 2, 5, 7]
    scores, live = np.zeros((4, 7)), np.zeros((4, 7), bool)
    for k, n in enumerate(lengths):
        scores[k, :n], live[k, :n] = rng.normal(size=n), True
    total, main, expected = pages.marginals(scores, live, pairs, first)
    want = np.zeros((2, 2))
    field = pages.Field([])
    field.pairs, field.first = pairs, first
    for k, n in enumerate(lengths):
        every = brute(scores[k, :n], pairs, first)
        z = sum(np.exp(v) for v in every.values())
        assert np.isclose(total[k], np.log(z))
        for t in range(n):
            assert np.isclose(main[k, t], sum(np.exp(v) for y, v in every.items() if y[t]) / z)
        for y, v in every.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += np.exp(v) / z
        assert field.labels(scores[k, :n].tolist()) == [bool(x) for x in max(every, key=every.get)]
    assert np.allclose(expected, want) and not main[~live].any()
    assert field.labels([]) == []


@pytest.fixture(scope="module")
def field():
    return pages.trained()


def test_held_out_pages(field):
    """At least 99 % of the blocks of pages of another seed get their label."""
    right = n = 0
    for html in labelled_pages(150, 4242):
        truth = [MAIN in t for t in texts(html)]
        got = [main for _, main in pages.main_blocks(html.replace(MAIN, ""), field)]
        right, n = right + sum(a == b for a, b in zip(truth, got, strict=True)), n + len(truth)
    assert right / n >= 0.99


ARTICLE = ["A title of the day", "The first paragraph says what there is to say, and says it in full.", "It goes on.", "Item one of a list", "Item two", "Another part", "And it ends here, with a last word on what came before."]
BODY = "<h1>{}</h1><p>{}</p><p>{}</p><ul><li>{}</li><li>{}</li></ul><h2>{}</h2><p>{}</p>".format(*ARTICLE)
LAYOUTS = [
    f"<html><body><header><h1>The Paper</h1><p>News since 1901.</p></header><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav><main><article>{BODY}</article></main><aside><h3>Popular</h3><p>This story was read a lot, and it may please you too.</p></aside><footer><p>&copy; The Paper. All rights reserved.</p></footer></body></html>",
    f"<body><div class='cookie-banner'><p>We use cookies to make this page better. Do you agree?</p><button>Yes</button></div><div id=header><a href=/>Site</a></div><div class=menu><a href=1>One</a> | <a href=2>Two</a></div><div id=content>{BODY}</div><div class=sidebar><p>Some words about the author, who writes here each week.</p></div><div id=footer>Imprint and contact</div>",
    f"<body><div class='ad'>Buy this now, it is cheap. You will like it.</div><article>{BODY}<div class='advert'><p>A word from those who pay for all this.</p></div></article><section class='comments'><h3>3 comments</h3><div class=comment><p>I have read this and I do not agree with a word of it.</p></div><div class=comment><p>Well said, and well written. Thank you.</p></div><form><label>Your name</label><input><textarea>Say it</textarea></form></section><footer>&copy; me</footer></body>",
    f"<body><main><div class='breadcrumb'><a href=/>Home</a> &gt; <a href=/x>X</a></div><article>{BODY}</article><form class='newsletter'><p>Get our letter each week. It is free, and you can leave at any time.</p><input></form><div class='notice'>This page was moved. Please change your links.</div></main><footer>End</footer></body>",
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_layouts(field, k):
    assert [t for t, main in pages.main_blocks(LAYOUTS[k], field) if main] == ARTICLE


def test_tables_of_pages(spark, field):
    rows = [(1, "u", LAYOUTS[0], "a"), (1, "u", LAYOUTS[0], "a"), (2, "u", None, "b"), (3, None, "", "c"), (4, "u", "<nav><a href=/>x</a></nav>", "d"), (None, "u", LAYOUTS[1] * 40, "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string").repartition(2)
    want = " ".join(ARTICLE)
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in pages.report(df).collect()), key=repr)
    assert got[1:] == [(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0), (4, "", 0)]
    assert got[0][1].startswith(want) and got[0][2] == len(got[0][1])
    assert pages.extract(df).columns == ["page_id", "url", "html", "text"]
    found = pages.blocks(df.where("page_id = 1").limit(1), field).where("main").orderBy("block_no")
    assert [r.block for r in found.collect()] == ARTICLE
    assert pages.report(df.limit(0)).collect() == []


def test_given_pages_equal_a_plain_cut(spark):
    if not Path(SF).exists():
        pytest.skip("the given tables are not here")
    df = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    for r in pages.report(df).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", html[r.page_id], re.S)[1]
        assert r.text == " ".join(unescape(re.sub(r"<[^>]*>?", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))).split())
