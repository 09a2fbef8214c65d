"""Labelled pages to train HTML extraction on: drawn from a grammar of layouts, with the main text known."""

from __future__ import annotations

import random

from .html_blocks import Block, leaf_blocks

PAGES, SEED = 2_000, 20240229
#: The attribute that marks main text in generated pages; what is learned from is the page without it.
MARK = "data-main-text"

SYLLABLES = "an be co da el fi go ha in ju ka lo mi no or pa qu re sa ti ul va we xi yo zé ße ñu".split()
#: Names that layouts of the web give to their parts.
MAIN = ["article", "content", "post", "entry", "post-content", "article-body", "story", "main", "text", "page-content", "entry-content", "blog-post"]
BODY = ["body", "post-body", "section-content", "body-content", "inner-content", "richtext", "prose", "copy", "content-inner"]
TITLE = ["entry-header", "post-header", "article-header", "title", "headline", "entry-title"]
SIDE = ["sidebar", "sidebar", "side", "widget", "related-posts", "share-buttons", "related", "right-col", "recommended", "popular", "tags", "share", "social", "author-bio", "newsletter", "subscribe"]
ADS = ["ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot", "advertisement"]
NOTICE = ["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "cookie-banner"]
TALK = ["comments", "comment", "comment-list", "commentlist", "comment-thread", "replies", "discussion", "respond", "disqus"]
MENU = ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "top-menu", "toc", "pagination", "skip"]
HEAD = ["header", "masthead", "site-header", "top", "logo", "branding"]
#: Names that say how a page or a part of it looks or behaves.
STATE = ["{}-enabled", "has-{}", "with-{}", "no-{}", "{}-open", "{}-fixed", "is-{}", "{}-active", "{}-group", "{}-visible"]
FOOT = ["footer", "footer", "site-footer", "page-footer", "bottom", "copyright", "legal", "colophon"]


class Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 18).capitalize() + self.rng.choice("....?!:") for _ in range(self.rng.randint(low, high)))

    def links(self, low: int = 2, high: int = 9) -> str:
        return "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></li>' for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int = 0, high: int = 6) -> str:
        """Text of any kind that a part that isn't main may hold."""
        r = self.rng
        kinds = [*(f"<p>{self.sentences(1, high)}</p>" for _ in range(4)), f"<ul>{self.links()}</ul>", self.sentences(1, 3), f"<h3>{self.words(1, 6)}</h3>", f'<a href="#">{self.words(1, 4)}</a>', f"<div>{self.words(1, 12)}</div>"]
        return "".join(r.choice(kinds) for _ in range(r.randint(1, 3)))

    def part(self, tags: list[str], names: list[str], inner: str) -> str:
        r = self.rng
        tag, name = r.choice(tags), r.choice(names)
        attr = r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {self.words(1, 1)}"'])
        if tag not in ("div", "section", "p", "ul", "span", "td") and r.random() < 0.5:
            attr = r.choice(["", f' class="{self.words(1, 1)}"'])
        return f"<{tag}{attr}>{inner}</{tag}>"

    def menu(self) -> str:
        r = self.rng
        bare = r.choice([" ", "<br>", " | ", ""]).join(f'<a href="/{self.words(1, 1)}">{self.words(1, 2)}</a>' for _ in range(r.randint(1, 6)))
        own = f"{self.words(1, 1).split('é')[0] or 'x'}-{r.choice(['nav', 'menu'])}"  # an element of the site's own
        own = own if own.isascii() else "x-nav"
        return self.part(["nav", "nav", "div", "ul", "td", own], MENU, r.choice([f"<ul>{self.links()}</ul>", f"<ul>{self.links()}</ul>", bare]))

    def advert(self) -> str:
        return self.part(["div", "div", "aside", "section"], ADS, self.prose())

    def comment_section(self) -> str:
        each = "".join(self.part(["div", "li", "article"], ["comment", "reply", "comment-body"], f"<p>{self.sentences(1, 6)}</p>") for _ in range(self.rng.choice([1, 2, 3, 4, 12])))
        return self.part(["section", "div", "ol"], TALK, f"<h2>{self.words(1, 3)}</h2>{each}")

    def form(self) -> str:
        return f"<form{self.rng.choice(['', ' class=search', ' id=signup'])}><label>{self.words(1, 4)}</label><p>{self.sentences(1, 2)}</p><textarea>{self.words(0, 3)}</textarea><button>{self.words(1, 2)}</button></form>"

    def outside(self) -> str:
        r = self.rng
        kind = r.randrange(9)
        if kind == 8:
            return self.part(["footer", "div", "div"], FOOT, self.prose())
        if kind < 2:
            return self.menu()
        if kind == 2:
            return self.advert()
        if kind == 3:
            return self.part(["aside", "div", "div"], SIDE, self.prose())
        if kind == 4:
            return self.part(["div", "section", "aside"], NOTICE, self.prose())
        if kind == 5:
            return self.form()
        if kind == 6:
            return self.comment_section()
        if r.random() < 0.15:
            return f"<noscript>{self.sentences(1, 1)}</noscript>"
        return self.part(["header", "div"], HEAD, r.choice([f"<h1>{self.words(1, 4)}</h1>", self.prose()]))

    def inline(self, text: str) -> str:
        r, words = self.rng, text.split()
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(words))
            words[k] = r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<b>{}", "{}<br>", "<code>{}</code>", "<svg><text>{}</text></svg>", "<video>{}</video>"]).format(words[k])
        return " ".join(words)

    def main_block(self) -> str:
        r = self.rng
        kind = r.randrange(10)
        text = self.inline(self.sentences(1, r.choice([1, 2, 8])))
        if kind < 6:
            return f"<p {MARK}>{text}{r.choice(['</p>', '</p>', ''])}"
        if kind == 6:
            return f"<h2 {MARK}>{self.words(1, 8)}</h2>"
        if kind == 7:
            return f"<blockquote><p {MARK}>{text}</p></blockquote>"
        if kind == 8:
            kind = r.choice(["ul", "ul", "ol"])
            text = [r.choice([self.inline(self.words(1, 12)), self.sentences(1, 1)]) for _ in range(r.randint(1, 5))]
            return f"<{kind}>" + "".join(f"<li {MARK}>{x}</li>" for x in text) + f"</{kind}>"
        return f"<pre {MARK}>{text}</pre>" if r.random() < 0.5 else f"<table><tr><td {MARK}>{self.words(1, 5)}</td><td {MARK}>{self.words(1, 5)}</td></tr></table>"

    def title(self) -> str:
        r = self.rng
        line = f"<{(h := r.choice(['h1', 'h1', 'h1', 'h2']))} {MARK}>{self.words(1, 12)}</{h}>"
        if r.random() < 0.15:  # a header of the article's own
            return f'<header class="{r.choice(TITLE)}">{line}</header>'
        return line

    def wrapped(self, blocks: list[str]) -> list[str]:
        """Main blocks within elements that say little: sections, and layers of any name."""
        r = self.rng
        kind = r.randrange(6)
        if kind < 3 or not blocks:
            return blocks
        if kind == 3:  # sections with headings
            cut = r.randint(0, len(blocks))
            return [f"<section>{f'<h3 {MARK}>{self.words(1, 5)}</h3>' * (r.random() < 0.7)}{''.join(part)}</section>" for part in (blocks[:cut], blocks[cut:]) if part]
        name = r.choice([self.words(1, 1), r.choice(BODY), r.choice(MAIN), "section", "inner", self.state(), self.state(), r.choice(self.layout())])
        tag = r.choice(["div", "div", "div", "section"])
        return [f'<{tag} {r.choice(["class", "class", "id"])}="{name}">{"".join(blocks)}</{tag}>']

    def layout(self) -> list[str]:
        """Names that other parts have, and that a wrapper of the text may have all the same: not those of readers' comments."""
        return self.rng.choice([SIDE, ADS, NOTICE, MENU, HEAD, FOOT, ["form", "form-group", "form-row", "text-widget", "widget-content"]])

    def state(self) -> str:
        name = self.rng.choice(self.rng.choice([SIDE, ADS, NOTICE, MENU, HEAD, FOOT, TALK, MAIN]))
        return self.rng.choice(STATE).format(name)

    def article(self) -> str:
        r = self.rng
        blocks = []
        for _ in range(r.randint(0, 12)):
            blocks.append(self.main_block())
            if r.random() < 0.15:
                blocks.append(self.outside())
        blocks = self.wrapped(blocks)
        if r.random() < 0.15:
            blocks = self.wrapped(blocks)
        if r.random() < 0.85:
            blocks = [self.title(), *blocks]
        inner = "\n".join(blocks) if r.random() < 0.5 else "".join(blocks)
        kind = r.randrange(12)
        if kind > 9:  # nothing but the text itself tells
            return r.choice([inner, f"<div>{inner}</div>", f'<div class="{self.words(1, 1)}">{inner}</div>'])
        if kind < 4:
            return f"<article{r.choice(['', '', f' class={r.choice(MAIN)}'])}>{inner}</article>"
        if kind == 4:
            return f"<main>{inner}</main>"
        if kind == 5:
            return f"<main><article>{inner}</article></main>"
        name = r.choice(MAIN)
        if kind == 9 and r.random() < 0.5:  # tables that lay out the page
            return f'<table><tr>{self.menu() * (r.random() < 0.5)}<td {r.choice(["class", "id"])}="{name}">{inner}</td></tr></table>'
        return f'<section id="{name}">{inner}</section>' if kind == 6 else f'<div {r.choice(["class", "id"])}="{name}">{inner}</div>'

    def page(self) -> str:
        r = self.rng
        before = "".join(self.outside() for _ in range(r.randint(0, 4)))
        after = "".join(self.outside() for _ in range(r.randint(0, 3)))
        foot = self.part(["footer", "footer", "div"], FOOT, r.choice([f"&copy; {self.words(1, 4)} &middot; {self.sentences(1, 2)}", self.prose()])) * (r.random() < 0.85)
        body = f"{before}{self.article()}{after}"
        if r.random() < 0.3:
            body = f'<div class="{self.words(1, 1)}">{body}</div>' if r.random() < 0.3 else body
            body = f'<div class="{r.choice(["wrapper", "container", "page", "site", "row"])}">{body}</div>'
        if r.random() < 0.12:  # a form around the page
            body = f'<form id="{r.choice(["aspnetForm", "form1", "mainform", "page"])}" method="post">{body}</form>'
        look = r.choice(["", "", f' class="{self.state()}"', f' class="{self.state()} {r.choice(MENU + SIDE)}"', f' id="{r.choice(MAIN + HEAD)}"'])
        return f"<html><head><title>{self.words(1, 5)}</title></head><body{look}>{body}{foot}{r.choice(['</body></html>', ''])}"


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    writer = Writer(random.Random(seed))
    out = []
    for _ in range(count):
        page = writer.page()
        labels = [int(any(MARK in e.names for e in b.path)) for b in leaf_blocks(page)]
        blocks = leaf_blocks(page.replace(f" {MARK}", ""))
        out.append((blocks, labels))
    return out
