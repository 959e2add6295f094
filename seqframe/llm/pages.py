"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read tag by tag into a stack of open elements; text between the borders of block elements is a leaf block. A block has
binary features of its ancestors (tags, groups of class, id and role names, the nearest such zone, and whether that lies within a
main part) and of its text (words, share in links, punctuation, place in the page, signs). A chain of two labels, main text or
not, is trained by gradient ascent on the pages of ``labelled.py``, a bounded number (``PAGES``) with a known answer, as no given
table has labels; Viterbi finds the best labels of a page. Pages are extracted where they lie, without a shuffle.

Defined cases: a null html is an empty one and gives an empty text, as does a page without main text. Unclosed elements end with
the page; a page cut within a tag or script loses that. Elements more than ``DEPTH`` deep become siblings. Text that is not shown
(scripts, styles, titles, templates, controls of forms) is no block. Character references are decoded, white space (of Unicode,
line breaks too) in a block becomes one space, blocks are joined by one. Pages of any length are worked on whole; repeated rows get
equal texts. Further columns stay, but one named like the output, which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MAIN, labelled_pages

#: HTML's block elements, those without content, those whose content is no markup, and those whose text is not shown.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = frozenset("noscript template svg select button object audio video canvas datalist head".split())
#: A start tag ends an open element of the second list, unless one of the third is open within it.
ENDS = [
    ("li", ("li",), ("ul", "ol", "menu", "dir")),
    ("dt dd", ("dt", "dd"), ("dl",)),
    ("td th", ("td", "th"), ("table", "tr")),
    ("tr", ("tr",), ("table",)),
    ("thead tbody tfoot", ("thead", "tbody", "tfoot"), ("table",)),
    ("option optgroup", ("option",), ("select", "datalist")),
]
CLOSED_BY = {tag: (ended, within) for tags, ended, within in ENDS for tag in tags.split()}
#: Elements that hold an open paragraph apart from what is outside.
SCOPES = ("table", "td", "th", "caption", "button", "object", "template")
#: Tags that say what part of a page they are, and the names in class, id and role that do.
ZONES = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form", "search": "form", "article": "main", "main": "main", "dialog": "notice"}
NAMES = [
    ("menu", r"nav\w*|menu\w*|breadcrumbs?|crumbs?|pagination|pager|paging|tabs?|toc|skip\w*|toolbar|topbar|links?|sitemap"),
    ("head", r"header|masthead|head|logo|branding|tagline|top"),
    ("foot", r"foot\w*|bottom|copyright|colophon|legal|imprint|contentinfo|credits?"),
    ("side", r"side\w*|aside|widgets?|rail|complementary|secondary"),
    ("notice", r"cookies?|consent|gdpr|notices?|alerts?|warnings?|modal|popup|overlay|toast|disclaimer|paywall|announce\w*|notification\w*|hidden|privacy"),
    ("ad", r"ads?|adv|advert\w*|adsense|adslot|adbox|sponsor\w*|promo\w*|banners?|teasers?|outbrain|taboola|dfp|commercial|affiliate\w*"),
    ("form", r"forms?|search\w*|login|signin|signup|register|subscri\w*|newsletter\w*|contact|poll|survey"),
    ("talk", r"comments?|commentlist|discuss\w*|disqus|repl(?:y|ies)|respond|responses?|feedback|reviews?|thread|forum|guestbook"),
    ("more", r"related\w*|recommend\w*|more|share|sharing|social|tags?|popular|trending|similar|readnext|follow\w*|meta|author\w*|bio|latest"),
    ("main", r"main|article\w*|content|post|entry|story|body|text|articlebody|prose"),
]
NAMED = [(group, re.compile(rf"(?:{names})\Z")) for group, names in NAMES]
#: Names that begin so tell of a state, not of a part.
STATES = ("has", "with", "without", "no", "is")
#: Zones in which an article is not the page's: a comment, a notice or a teaser.
ASIDE = ("menu", "foot", "side", "notice", "ad", "talk", "more")
DEPTH = 512
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|</?[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|style|aria-hidden)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?<![\w-])(hidden)(?![\w=-])", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PAGES, ROUNDS, RATE, DECAY, SEED = 800, 120, 0.3, 3e-4, 11


def zones_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The groups that an element's tag and names belong to; of each list of names in their order."""
    found = [ZONES[tag]] if tag in ZONES else []
    for name, value, bare in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if bare or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            found.append("notice")
        elif name in ("class", "id", "role", "itemprop"):
            for one in value.split():
                parts = [p.lower() for p in PART.findall(one)]
                if parts and parts[0] not in STATES:
                    found += [group for p in parts for group, names in NAMED if names.match(p)]
    return tuple(dict.fromkeys(found))


class Element:
    """An open element: its name, whether its text is shown, its zone, and the features that it gives to blocks within."""

    __slots__ = ("name", "unseen", "near", "within", "inherited")

    def __init__(self, name: str, parent: Element | None, zones: tuple[str, ...]):
        self.name = name
        self.unseen = name in UNSEEN or (parent is not None and parent.unseen)
        near, within, inherited = (parent.near, parent.within, parent.inherited) if parent else ("", False, frozenset())
        if name not in ("body", "html") and zones:
            # of several names the one that says most: anything but main, which stands for nothing within what is aside of the article
            found = next((z for z in zones if z != "main"), "main")
            if found != "main" or near not in ASIDE:
                within = within or near == "main"
                near = found
        self.near, self.within = near, within
        self.inherited = inherited | {f"tag {name}"} | {f"zone {z}" for z in zones if name not in ("body", "html")}


class Page:
    """Leaf blocks of one page: features and text of each."""

    def __init__(self, html: str):
        self.blocks: list[tuple[list[str], str]] = []
        self.stack, self.open = [Element("", None, ())], {}
        self.text, self.linked = [], 0
        self.known: dict[tuple, Element] = {}
        at, end = 0, len(html)
        while at < end:
            m = TAG.search(html, at)
            self._words(html[at : m.start() if m else end])
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._end(name)
            elif name in RAW:
                close = _closing(name).search(html, at)
                at = close.end() if close else end
            else:
                self._start(name, m[3] or m[6] or "")
        self._block()
        self._place()

    def _words(self, text: str) -> None:
        if text and not self.stack[-1].unseen:
            self.text.append(text)
            if self.open.get("a"):
                self.linked += len(text)

    def _pop(self, n: int) -> None:
        """Closes the elements from the n-th of the stack on."""
        if any(e.name in BLOCKS for e in self.stack[n:]):
            self._block()
        for e in self.stack[n:]:
            self.open[e.name] -= 1
        del self.stack[n:]

    def _close(self, names: tuple[str, ...], within: tuple[str, ...]) -> None:
        if any(self.open.get(x) for x in names):
            for n in range(len(self.stack) - 1, 0, -1):
                if self.stack[n].name in names:
                    return self._pop(n)
                if self.stack[n].name in within:
                    return None
        return None

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            return self.text.append(" ")
        if name in BLOCKS:
            self._block()
            self._close(("p",), SCOPES)
            if name in CLOSED_BY:
                self._close(*CLOSED_BY[name])
            if name == "body":
                self._close(("head",), ())
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            return None
        if len(self.stack) > DEPTH:
            self._pop(len(self.stack) - 1)
        parent = self.stack[-1]
        key = (id(parent), name, attributes)
        element = self.known.get(key)
        if element is None:
            element = self.known[key] = Element(name, parent, zones_of(name, attributes))
        self.stack.append(element)
        self.open[name] = self.open.get(name, 0) + 1
        return None

    def _end(self, name: str) -> None:
        if not self.open.get(name):
            if name in ("p", "br"):
                self.text.append(" ")
            return
        for n in range(len(self.stack) - 1, 0, -1):
            if self.stack[n].name == name:
                return self._pop(n)
            if name not in BLOCKS and name not in UNSEEN and self.stack[n].name in BLOCKS:
                return

    def _block(self) -> None:
        if not self.text:
            return
        raw, linked = "".join(self.text), self.linked
        self.text, self.linked = [], 0
        text = " ".join(unescape(raw).split())
        if text:
            element = next(e for e in reversed(self.stack) if e.name in BLOCKS or not e.name)
            self.blocks.append((features(element, text, linked / len(raw)), text))

    def _place(self) -> None:
        """Adds features of the place in the page."""
        size = sum(len(t) for _, t in self.blocks)
        so_far = 0
        for k, (found, text) in enumerate(self.blocks):
            found += [f"at {10 * so_far // max(1, size)}", "first" if k == 0 else "last" if k == len(self.blocks) - 1 else "inner"]
            so_far += len(text)


@lru_cache(maxsize=64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?:\s[^>]*|/[^>]*)?>", re.I)


def features(element: Element, text: str, linked: float) -> list[str]:
    """What is seen of a block but for its place."""
    words = text.split(" ")
    n = len(words)
    found = list(element.inherited)
    found.append(f"own {element.name}")
    found.append(f"near {element.near} {element.within}")
    found.append(f"near {element.near} own {element.name}")
    found.append(f"words {min(n.bit_length(), 8)}")
    found.append(f"links {int(4 * linked)}")
    found.append(f"near {element.near} words {min(n.bit_length(), 8)}")
    ends = sum(w[-1] in ".!?" for w in words)
    found.append(f"sentences {min(ends, 3)}")
    found.append("ends" if text[-1] in ".!?:\"'”»" else "open")
    if n > 2 and sum(w[0].isupper() for w in words) > 0.6 * n:
        found.append("capitals")
    found += [f"sign {s}" for s in "©|»@·" if s in text]
    if sum(c.isdigit() for c in text) > 0.2 * len(text):
        found.append("digits")
    return found


class Field:
    """The trained chain: a weight for each feature, for main text against other text, and for each pair of neighbouring labels."""

    def __init__(self, names: list[str]):
        self.number = {f: k for k, f in enumerate(names)}
        self.weights = np.zeros(len(names))
        self.pairs, self.first = np.zeros((2, 2)), 0.0

    def scores(self, blocks: list[list[str]]) -> list[float]:
        """Of each block: the weights of those of its features that are known."""
        number, weights = self.number, self.weights.tolist()
        return [sum(weights[number[f]] for f in set(found) if f in number) for found in blocks]

    def labels(self, scores: list[float]) -> list[bool]:
        """Viterbi's labels; of equals the other label than main text."""
        if not scores:
            return []
        (oo, om), (mo, mm) = self.pairs.tolist()
        other, main, back = 0.0, scores[0] + self.first, []
        for s in scores[1:]:
            back.append((main + mo > other + oo, main + mm > other + om))
            other, main = max(other + oo, main + mo), max(other + om, main + mm) + s
        found = [main > other]
        for b in reversed(back):
            found.append(b[found[-1]])
        return found[::-1]


def marginals(scores: np.ndarray, live: np.ndarray, pairs: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded chains (chain, block): the logarithm of the sum over labellings, each block's chance of main text, and the expected
    number of each pair of labels. ``live`` marks blocks that are no padding."""
    n, width = scores.shape
    order = np.argsort(-live.sum(1), kind="stable")
    # chains that still go on at each block come first
    many = live.sum(0)
    unit = np.zeros((n, width, 2))
    unit[:, :, 1] = scores[order]
    unit[:, 0, 1] += first
    alpha, beta = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    alpha[:, 0] = unit[:, 0]
    total = np.logaddexp(alpha[:, 0, 0], alpha[:, 0, 1])
    for t in range(1, width):
        own, last = slice(many[t]), alpha[: many[t], t - 1]
        for k in (0, 1):
            alpha[own, t, k] = np.logaddexp(last[:, 0] + pairs[0, k], last[:, 1] + pairs[1, k]) + unit[own, t, k]
        total[own] = np.logaddexp(alpha[own, t, 0], alpha[own, t, 1])
    expected = np.zeros((2, 2))
    for t in range(width - 1, 0, -1):
        own = slice(many[t])
        after = unit[own, t] + beta[own, t]
        for k in (0, 1):
            to = pairs[k] + after
            expected[k] += np.exp(alpha[own, t - 1, k, None] + to - total[own, None]).sum(0)
            beta[own, t - 1, k] = np.logaddexp(to[:, 0], to[:, 1])
    main = np.zeros((n, width))
    main[order] = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None])
    back = np.empty(n)
    back[order] = total
    return back, main * live, expected


def train(pages: list[str], rounds: int = ROUNDS) -> Field:
    """The chain fitted to pages in whose main text each block holds the mark ``MAIN``: steps of Adam on the log-likelihood."""
    chains, truth = [], []
    for html in pages:
        truth.append([MAIN in text for _, text in Page(html).blocks])
        chains.append([found for found, _ in Page(html.replace(MAIN, "")).blocks])
    keep = [k for k, c in enumerate(chains) if c]
    chains, truth = [chains[k] for k in keep], [truth[k] for k in keep]
    field = Field(sorted({f for c in chains for b in c for f in b}))
    width = max(map(len, chains))
    live, y = np.zeros((len(chains), width), bool), np.zeros((len(chains), width))
    rows, cols = [], []
    for k, c in enumerate(chains):
        live[k, : len(c)], y[k, : len(c)] = True, truth[k]
        for t, b in enumerate(c):
            ids = sorted({field.number[f] for f in b})
            rows += [k * width + t] * len(ids)
            cols += ids
    rows, cols = np.array(rows), np.array(cols)
    now, then = y[:, 1:].astype(int), y[:, :-1].astype(int)
    seen = np.array([[np.sum(live[:, 1:] & (then == a) & (now == b)) for b in (0, 1)] for a in (0, 1)], float)
    x = np.zeros(len(field.weights) + 5)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        weights, pairs, first = x[:-5], x[-5:-1].reshape(2, 2), x[-1]
        scores = np.bincount(rows, weights[cols], live.size).reshape(live.shape)
        _, main, expected = marginals(scores, live, pairs, first)
        miss = y - main
        rise = np.concatenate([np.bincount(cols, miss.ravel()[rows], len(weights)), (seen - expected).ravel(), [miss[:, 0].sum()]]) / len(chains) - DECAY * x
        m, v = 0.9 * m + 0.1 * rise, 0.99 * v + 0.01 * rise**2
        x = x + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.weights, field.pairs, field.first = x[:-5], x[-5:-1].reshape(2, 2), float(x[-1])
    return field


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = SEED) -> Field:
    """The chain fitted to ``pages`` labelled pages, on the driver."""
    return train(labelled_pages(pages, seed))


def main_blocks(html: str | None, field: Field) -> list[tuple[str, bool]]:
    """Text and label of each block of a page."""
    blocks = Page(html or "").blocks
    return list(zip((t for _, t in blocks), field.labels(field.scores([f for f, _ in blocks]))))


def extract(pages: DataFrame, field: Field | None = None, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``: the main text."""
    field = field or trained()

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda h: " ".join(t for t, main in main_blocks(h, field) if main))

    return pages.withColumn(out, F.pandas_udf(run, "string")(F.coalesce(F.col(html), F.lit(""))))


def blocks(pages: DataFrame, field: Field | None = None, html: str = "html") -> DataFrame:
    """``pages`` with block_no (from 0), block and main: a row for each leaf block of each page."""
    field = field or trained()

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda h: [{"block": t, "main": bool(main)} for t, main in main_blocks(h, field)])

    kept = [c for c in pages.columns if c.lower() not in ("block_no", "block", "main")]
    found = F.pandas_udf(run, "array<struct<block: string, main: boolean>>")(F.coalesce(F.col(html), F.lit("")))
    return pages.select(*kept, F.posexplode(found).alias("block_no", "x")).select(*kept, "block_no", "x.block", "x.main")


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
