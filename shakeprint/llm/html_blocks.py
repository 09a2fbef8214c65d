"""Pages as leaf blocks: runs of text between the edges of block elements, each with the elements that hold it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

#: Fixed values from the HTML standard.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul caption optgroup".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title"
CLOSES_P = BLOCK - set("body html option optgroup tbody td tfoot th thead tr caption".split())
#: A start tag ends an open element of these, up to one of those.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements deeper than this many others count as those around them.
DEPTH = 400
#: Elements that an end tag inside can't close.
WALLS = {"td", "th", "table", "html", "body"}

TOKEN = re.compile(
    rf"""<!--(?:>|->|.*?(?:--!?>|\Z))
    |<(?P<raw>{RAW})(?=[\s/>])(?:[^>"']|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)
    |<[!?/][^>]*+(?:>|\Z)""",
    re.IGNORECASE | re.DOTALL | re.VERBOSE,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
NAME_PART = re.compile(r"[a-z]+")
#: Parts of a name that says how a page looks or behaves, and not what an element is: such a name is kept whole only.
STATES = set("has with without no is not open opened enabled disabled fixed active visible hidden loaded ready sticky collapsed expanded logged group on off js".split())
#: Names of elements that commonly hold an article, and words of what readers say.
HOLDERS = {"article", "content", "post", "entry", "story", "main"}
TALK = set("comment comments commentlist reply replies respond discussion disqus".split())
#: Elements that say by themselves what they hold.
PARTS = set("aside details dialog fieldset footer form header menu nav section".split())
#: An element with so much of the text of the page's main element (or page) is wide.
WIDE = 0.5


@dataclass(frozen=True)
class Element:
    tag: str
    #: Lower-case words of class, id, role and aria-label, and names of data attributes.
    names: tuple[str, ...] = ()
    #: What it holds: "around" the page's main element, "wide" with most of its text, or neither.
    scope: str = ""

    @property
    def holds(self) -> bool:
        """Whether it is of the kind that holds an article."""
        return (self.tag in ("article", "main") or not HOLDERS.isdisjoint(self.names)) and TALK.isdisjoint(self.names)


@lru_cache(maxsize=10_000)
def element(tag: str, names: tuple[str, ...], scope: str = "") -> Element:
    return Element(tag, names, scope)


@dataclass
class Opened:
    """An element of the page as it is read, with how much text that isn't linked came before its start and its end."""

    element: Element
    parent: int
    start: int
    end: int = 0

    @property
    def held(self) -> int:
        return self.end - self.start


@lru_cache(maxsize=10_000)
def start_tag(tag: str, attrs: str) -> Element:
    names: list[str] = NAME_PART.findall(tag) if "-" in tag else []  # an element of the site's own
    for m in ATTRIBUTE.finditer(attrs):
        key = m[1].lower()
        if key in ("class", "id", "role", "aria-label", "itemprop"):
            for name in unescape((m[2] or "").strip("\"'")).lower().split():
                parts = NAME_PART.findall(name)
                names.append(name)
                if STATES.isdisjoint(parts):
                    names += parts
        elif key.startswith("data-"):
            names.append(key)
    return element(tag, tuple(dict.fromkeys(names)))


@dataclass
class Block:
    text: str
    path: list[Element]  # the elements around it, the outermost first
    link_chars: int = 0


def scoped(opened: list[Opened], total: int) -> list[Element]:
    """The elements, each with its scope. The main element is the innermost of those that commonly hold an article with
    nearly as much text as the largest of them. What says something of the whole page says nothing of a block: body, html and what
    is around the main element lose their names."""
    holders = [k for k, o in enumerate(opened) if o.element.holds and o.held]
    most = max((opened[k].held for k in holders), default=0)
    main = next((k for k in reversed(holders) if opened[k].held >= 0.6 * most), -1)
    around, k = set(), opened[main].parent if main >= 0 else -1
    while k >= 0:
        around.add(k)
        k = opened[k].parent
    limit = WIDE * (opened[main].held if main >= 0 else total)
    out, inside = [], []
    for k, o in enumerate(opened):
        inside.append(main < 0 or o.parent == main or o.parent >= 0 and inside[o.parent] and main >= 0)
        if k in around or o.element.tag in ("html", "body"):
            out.append(element("div", (), "around"))
        elif k != main and inside[k] and o.held >= limit > 0 and (o.element.names or o.element.tag in PARTS):
            out.append(element(o.element.tag, o.element.names, "wide"))
        else:
            out.append(o.element)
    return out


def leaf_blocks(html: str) -> list[Block]:
    """The page's blocks with text, in order: character references decoded, white space made one space, trimmed.

    Comments, scripts, styles and the head are left out with their content, and nothing else. Missing end tags are
    supplied as browsers do; a tag that the page's end cuts off is left out.
    """
    blocks: list[tuple[str, int, int]] = []
    opened: list[Opened] = []
    stack: list[Element] = []
    places: list[int] = []  # of the stack's elements in opened
    parts: list[str] = []
    linked = at = links = heads = told = 0

    def flush():
        nonlocal linked, told
        text = " ".join("".join(parts).split())
        if text and not heads:
            blocks.append((text, places[-1] if places else -1, min(linked, len(text))))
            told += len(text) - blocks[-1][2]
        parts.clear()
        linked = 0

    def close(k: int):
        """Closes the stack down to k elements."""
        nonlocal links, heads
        if any(e.tag in BLOCK or e.tag == "head" for e in stack[k:]):
            flush()
        links -= sum(e.tag == "a" for e in stack[k:])
        heads -= sum(e.tag == "head" for e in stack[k:])
        for place in places[k:]:
            opened[place].end = told
        del stack[k:], places[k:]

    def words(text: str):
        nonlocal linked
        if text:
            text = unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())

    while m := TOKEN.search(html, at):
        words(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag == "br":
                parts.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body") or stack[k].tag in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" " if tag == "br" else "")
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in ENDS:
            ended, walls = ENDS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ended:
                    close(k)
                    break
                if stack[k].tag in walls:
                    break
        if tag in BLOCK or tag == "head":
            flush()
        if tag in BLOCK and heads:  # a head that was never closed
            close(next(k for k, e in enumerate(stack) if e.tag == "head"))
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        opened.append(Opened(start_tag(tag, attrs), places[-1] if places else -1, told))
        places.append(len(opened) - 1)
        stack.append(opened[-1].element)
        links += tag == "a"
        heads += tag == "head"
    words(html[at:])
    flush()
    close(0)
    elements, paths = scoped(opened, told), {-1: []}

    def path(place: int) -> list[Element]:
        up = []
        while place not in paths:
            up.append(place)
            place = opened[place].parent
        for k in reversed(up):
            paths[k] = [*paths[opened[k].parent], elements[k]] if len(paths[opened[k].parent]) < DEPTH else paths[opened[k].parent]
        return paths[up[0] if up else place]

    return [Block(text, path(place), linked) for text, place, linked in blocks]
