"""Labelled web pages: layouts whose main text is known, filled with made-up sentences, to train the extraction on.

Each block of main text holds the character ``MAIN``; everything else on the page is menus, headers, footers, sidebars, notices,
adverts, forms, comments and other text that an article does without. Layouts differ in how they name, nest and leave out
these, and prose stands in either kind of block, so words alone do not tell them apart.
"""

from __future__ import annotations

import random
import re

#: A character of Unicode's private use area.
MAIN = ""
SYLLABLES = "ba de ki lo mu na per ra sol ti un ver wo xi ya zu an er in st".split()
#: Names that pages give to their parts.
MENUS = ["nav", "navbar", "main-nav", "menu", "site-menu", "topnav", "navigation", "breadcrumb", "skip-link", "toc", "pagination", "mainMenu"]
HEADS = ["header", "site-header", "masthead", "page-header", "logo", "branding", "top-header"]
FEET = ["footer", "site-footer", "page-footer", "bottom", "copyright", "colophon", "legal", "footer-links"]
SIDES = ["sidebar", "side-column", "widget", "widget-area", "right-rail", "aside", "secondary", "sidebar-left"]
NOTICES = ["cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "modal", "popup", "overlay", "announcement", "disclaimer", "privacy-notice"]
ADVERTS = ["ad", "ads", "advert", "advertisement", "ad-slot", "banner", "sponsored", "promo", "adsense", "sponsor-box", "teaser", "ad_300"]
FORMS = ["search", "search-form", "newsletter", "subscribe", "login", "signup", "contact-form", "poll"]
TALKS = ["comments", "comment-list", "commentlist", "discussion", "responses", "disqus_thread", "replies", "user-comments", "reviews", "reader-comments"]
MORES = ["related", "related-posts", "share", "social", "tags", "recommended", "popular", "more-stories", "author-bio", "post-meta", "trending"]
MAINS = ["content", "main-content", "article", "article-body", "post", "post-content", "entry", "entry-content", "story", "story-body", "text", "main", "articleBody", "hentry post"]
WRAPS = ["wrapper", "container", "page", "row", "col-md-8", "layout", "site", "inner", "grid", "has-sidebar", "with-nav"]


class Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def one(self, *of):
        return self.rng.choice(of)

    def word(self) -> str:
        return "".join(self.rng.choices(SYLLABLES, k=self.rng.choice((1, 1, 2, 2, 3))))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(least, most)))

    def sentence(self) -> str:
        text = self.words(1, 22) if self.rng.random() < 0.8 else self.words(1, 3) + ", " + self.words(2, 12)
        return text.capitalize() + self.one(".", ".", ".", ".", "!", "?")

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def inline(self, text: str) -> str:
        """Prose with some of its words in elements."""
        words = text.split(" ")
        for _ in range(self.rng.choice((0, 0, 1, 2))):
            k = self.rng.randrange(len(words))
            words[k] = self.one("<b>{}</b>", '<a href="/x">{}</a>', "<em>{}</em>", "<code>{}</code>", "{}&amp;", "<span class=x>{}</span>", "{}<br>").format(words[k])
        return " ".join(words)

    def links(self, n: int) -> str:
        return self.one(" ", " | ", " &middot; ", "\n").join(f'<a href="/{k}">{self.words(1, 3).capitalize()}</a>' for k in range(n))

    def listed(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{self.words(1, 6).capitalize()}</a>{self.one("", "</li>")}' for _ in range(n)) + "</ul>"

    def named(self, names: list[str], inner: str, tags: tuple[str, ...] = ("div", "div", "section")) -> str:
        tag = self.one(*tags)
        if tag == "p" and re.search("<(p|h[1-6]|ul|div)", inner):
            tag = "div"  # a paragraph holds no blocks
        name = self.one(*names)
        how = self.one(f'class="{name}"', f'id="{name}"', f'class="{name} box"', f"class='block {name}'", f"class={name.replace(' ', '-')}")
        return f"<{tag} {how}>{inner}</{tag}>"

    def either(self, names: list[str], tag: str, inner: str) -> str:
        """A part named by its tag, by a name, or by both."""
        return self.one(f"<{tag}>{inner}</{tag}>", self.named(names, inner), self.named(names, inner, (tag,)))

    def filler(self) -> str:
        """What a part that is no main text may hold."""
        return self.one(self.listed(self.rng.randint(1, 7)), self.links(self.rng.randint(1, 6)), self.prose(2), f"<p>{self.prose(3)}</p>", f"<h3>{self.words(1, 4)}</h3><p>{self.prose(3)}", f"<h2>{self.words(1, 5)}</h2>{self.listed(4)}")

    def menu(self) -> str:
        return self.either(MENUS, "nav", self.one(self.listed(self.rng.randint(2, 8)), self.links(self.rng.randint(2, 8))))

    def head(self) -> str:
        title = self.one(f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.sentence()}</p>", f"<h1>{self.words(1, 3)}</h1><p>{self.prose(2)}</p>")
        return self.either(HEADS, "header", title + self.one("", "", self.menu(), self.form()))

    def bar(self) -> str:
        """A header by name only: an article's own ``header`` element holds its title."""
        return self.named(HEADS, self.one(self.prose(2), f"<p>{self.prose(2)}</p>", f"<h1>{self.words(1, 3)}</h1><p>{self.prose(2)}</p>", self.links(3)))

    def foot(self) -> str:
        return self.either(FEET, "footer", self.one(f"&copy; {self.words(1, 2)}.example &middot; {self.prose(2)}", self.links(5), f"<p>{self.prose(3)}</p>", f"<p>&copy; 2024 {self.words(1, 5)}</p>{self.listed(3)}", self.filler()))

    def side(self) -> str:
        return self.either(SIDES, "aside", "".join(self.filler() for _ in range(self.rng.randint(1, 3))))

    def notice(self) -> str:
        return self.named(NOTICES, self.one(self.prose(3), f"<p>{self.prose(3)}</p><button>OK</button>", f"<p>{self.prose(2)}</p><a href=#>{self.word()}</a>"), ("div", "div", "section", "p", "aside", "dialog"))

    def advert(self) -> str:
        return self.named(ADVERTS, self.one(self.prose(2), f"<p>{self.prose(3)}</p>", f'<a href="/buy">{self.words(2, 9)}</a>', f"<h4>{self.words(1, 4)}</h4>{self.prose(2)}"), ("div", "div", "aside", "section", "p", "ins"))

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=x>" for _ in range(self.rng.randint(1, 3)))
        inner = self.one("", f"<p>{self.prose(2)}</p>", f"<h3>{self.words(1, 5)}</h3>", self.sentence()) + fields + self.one("", "<button>Go</button>", f"<textarea>{self.words(1, 4)}</textarea>")
        return self.one(f"<form>{inner}</form>", self.named(FORMS, f"<form action=/s>{inner}</form>"), self.named(FORMS, inner, ("form", "div")))

    def talk(self) -> str:
        one = lambda: self.one("<li>{}</li>", '<div class="comment">{}</div>', '<article class="comment">{}</article>', "<div>{}</div>", "<p>{}</p>").format(self.one("", f"<b>{self.word()}</b> ", f"<span class=author>{self.word()}</span> <time>3 May</time>") + self.one("{}", "<p>{}</p>").format(self.inline(self.prose(5))))
        many = "".join(one() for _ in range(self.rng.randint(1, 6)))
        return self.named(TALKS, self.one("", f"<h3>{self.rng.randint(2, 90)} {self.words(1, 2)}</h3>") + self.one(many, f"<ol>{many}</ol>") + self.one("", self.form()), ("div", "section", "section", "aside"))

    def more(self) -> str:
        return self.named(MORES, self.one(self.listed(4), f"<h3>{self.words(1, 3)}</h3>{self.listed(3)}", self.links(4), f"<p>{self.prose(2)}</p>"), ("div", "div", "section", "aside", "ul", "p"))

    def marked(self, text: str) -> str:
        return MAIN + self.inline(text)

    def paragraph(self) -> str:
        p = lambda: self.marked(self.prose(7))
        return self.one(
            f"<p>{p()}</p>", f"<p>{p()}</p>", f"<p>{p()}</p>", f"<p>{p()}", f"<p><b>{p()}<br><p>{p()}</p>", f"<p>{MAIN}{self.sentence()}</p>", f"<h2>{self.marked(self.words(1, 8).capitalize())}</h2><p>{p()}</p>", f"<h3>{self.marked(self.sentence())}</h3><p>{p()}",
            "<ul>" + "".join(f"<li>{self.marked(self.words(1, 14))}</li>" for _ in range(3)) + "</ul>", "<ol>" + "".join(f"<li>{self.marked(self.sentence())}" for _ in range(3)) + "</ol>",
            f"<blockquote>{p()}</blockquote>", f"<blockquote><p>{p()}</p></blockquote>", f"<div>{p()}</div>", f"<pre>{p()}</pre>", f"<p class=lead>{p()}</p>", f"<figure><img src=x><figcaption>{self.marked(self.words(2, 12))}</figcaption></figure>",
            "<table>" + "".join(f"<tr><td>{self.marked(self.words(1, 4))}</td><td>{MAIN}{self.rng.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>", f"<dl><dt>{self.marked(self.words(1, 3))}<dd>{p()}</dl>", f"<section><h2>{self.marked(self.words(1, 5))}</h2><p>{p()}</p></section>",
        )

    def article(self, bare: bool) -> str:
        title = f"<h1>{self.marked(self.words(2, 9).capitalize())}{self.one('', '.')}</h1>"
        title = self.one(title, title, title, "", title if bare else f"<header>{title}{self.one('', f'<p>{self.prose(2)}</p>')}</header>", f"<h2>{self.marked(self.words(2, 9))}</h2>")
        parts = [self.paragraph() for _ in range(self.rng.choice((1, 2, 3, 5, 8, 13)))]
        for noise in (self.advert, self.side, self.more, self.menu, self.form, self.notice, self.foot, self.bar, self.talk):
            if self.rng.random() < 0.2:
                parts.insert(self.rng.randint(0, len(parts)), noise())
        tail = [noise() for noise in (self.more, self.talk, self.form, self.advert) if self.rng.random() < 0.2]
        if self.rng.random() < 0.08:
            tail.append(f"<footer>{self.filler()}</footer>")
        inner = title + "".join(parts) + "".join(tail)
        if bare:
            return inner
        return self.one(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f'<div role="main">{inner}</div>', self.named(MAINS, inner), self.named(MAINS, inner), self.named(MAINS, inner, ("article", "main", "td")), f"<article>{self.named(MAINS, inner)}</article>", f'<article itemscope><div itemprop="articleBody">{inner}</div></article>')

    def page(self) -> str:
        r = self.rng.random
        before = [part() for part, chance in ((self.notice, 0.3), (self.advert, 0.4), (self.head, 0.5), (self.menu, 0.7), (self.form, 0.15), (self.side, 0.15), (self.more, 0.05)) if r() < chance]
        after = [part() for part, chance in ((self.advert, 0.3), (self.more, 0.25), (self.talk, 0.35), (self.side, 0.35), (self.form, 0.2), (self.notice, 0.15), (self.menu, 0.1)) if r() < chance]
        if r() < 0.3:
            self.rng.shuffle(before)
        self.rng.shuffle(after)
        if r() < 0.75:
            after.append(self.foot())
        main = self.article(r() < 0.12)
        if r() < 0.3:
            main = self.named(WRAPS, main + (after.pop(0) if after and r() < 0.4 else ""))
        inner = "".join(before) + "<!-- x -->" + main + "".join(after)
        if r() < 0.3:
            inner = self.named(WRAPS, inner)
        elif r() < 0.08:
            inner = f"<table><tr><td>{''.join(before)}</td><td>{main}</td><td>{''.join(after) or self.menu()}</td></tr></table>"
        body = self.one("<body>", "<body>", f'<body class="{self.one(*WRAPS, "single-post", "menu-open")}">')
        page = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{self.words(1, 6)}</title><style>p{{x:y}}</style></head>{body}<script>var t='</p>';</script>{inner}"
        return page + ("</body></html>" if r() < 0.8 else "")


def labelled_pages(n: int, seed: int) -> list[str]:
    """``n`` pages, the same for the same seed."""
    writer = Writer(random.Random(seed))
    return [writer.page() for _ in range(n)]
