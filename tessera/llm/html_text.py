"""Main text of HTML pages by the maximum-scoring contiguous run of tokens.

A page becomes a sequence of tokens: words and tags.  Each word scores by a logistic model of its place (the elements
around it, what the class or id values of these hint at, the share of links in its container) and of its block's shape
(share of links, length, how it ends; outside article and main elements), positive where such words are content; each tag scores negative.  A linear scan
finds the run with the largest sum, the content region.  Inside it, blocks whose words score negative for their place (a
menu, advert, form or comment within the article) are left out; a block's shape alone leaves out nothing.  As they are,
such blocks cost ``BRIDGE`` at most between two pieces of content, however long they are, unless the article or main
element has ended before them.

The weights come from labelled pages: ``labelled_pages`` composes pages of many layouts with known content words (fixed
seed), and ``learn`` fits the model on them in numpy.  Half of these pages have class names that hint at nothing, and
on some the names mislead, so the weights rest on structure as well: what stands outside the article or main element of a
page that has one, containers that hold links for the most part, and containers that stand beside others alike, each a few
words and then more (readers' comments).  A class or id value hints at something only if all its words do or are plain
words of layout (``share-bar``, not ``social-policy``).  Pass other labelled pages to ``learn`` for other sites.

Text rules.  Scripts, styles, comments and other raw elements are never text.  Character references are decoded,
white space in a block becomes one space, blocks are trimmed and joined in page order by one space.  Inline tags join
what they separate; block tags and line breaks separate.  Tags left open or cut off are closed as browsers do.  A
drawing or player element that closes itself or is never closed hides nothing; a script or style element that is never
closed hides what comes before the next block tag.

Edge cases.  Null or empty html, and pages without words, give an empty text.  Of runs with equal sums the first is
taken.  Repeated rows give repeated rows.  Whole pages are read, whatever their length, in time linear in it.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import light_batches, slices

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_OPENS = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_STOP = re.compile(r"""[.!?\u2026\u3002\uff01\uff1f:;]["'\u201d\u2019\u00bb)\]]*$""")

# Fixed values of HTML: elements by behaviour.
RAW = {"script", "style", "title", "noscript", "textarea", "iframe", "noframes", "noembed", "xmp"}
DRAWN = {"svg", "math", "object", "audio", "video", "canvas", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SECTIONS = {"article", "aside", "body", "footer", "form", "header", "main", "nav", "section"}
#: Elements that hold blocks; their class and id values tell about all that is in them.
BOXES = SECTIONS | {"blockquote", "details", "dialog", "div", "dl", "fieldset", "figure", "menu", "ol", "table", "td", "ul"}
#: Words in class, id or role values, by what they hint at.
HINTS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs",
    "side": "sidebar side aside related recommended widget rail popular trending teaser",
    "comment": "comment comments reply replies discussion respond disqus reader feedback",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay paywall newsletter subscribe signup disclaimer toast",
    "edge": "header masthead footer copyright legal social share sharing login search toolbar skip",
    "content": "content article post entry story main text body paragraph",
}
#: Words that may stand beside those in a class or id value; a value with any other word hints at nothing.
PLAIN = set("area bar block body bottom box btn button buttons card cell center col column container desktop el fixed global grid group head heading holder icon icons inner item items js label layout left link links list mobile module outer page panel primary region right row secondary section site slot small sticky title top unit view wp wrap wrapper zone".split())
#: The most that rejected blocks between two pieces of content cost: less than one word of a plain paragraph.
BRIDGE = 2.0
FRAMES = {"in:article", "in:main"}
#: Words that an article or main element must hold for the rest of the page to count as outside.
LEAST_FRAMED = 12
_HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}
ELEMENTS = ("a", "article", "aside", "blockquote", "button", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "head", "header", "label", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "select", "summary", "table", "ul", "dialog", "details", "option")
#: Of a block: its share of linked words (none, some, most), its words (up to 3, 9, 24, more), and whether it ends like a sentence.
SHAPES = ("links:some", "links:most", "words:3", "words:9", "words:24", "stop")
#: Of a container: the share of linked words among its own blocks, and (outside article and main elements) whether it has
#: several of which none ends like a sentence.
DENSITY = ("box:some", "box:most")
LOOSE = "box:loose"
#: All within a container that holds links for the most part; all within one that stands beside others alike, each a few
#: words and then more, as readers' comments do; and a place outside the article or main element of a page that has one.
LINKED, ALIKE, OUTSIDE = "box:linked", "box:alike", "outside"
#: The most words of a comment's first line.
BYLINE = 5
FEATURES = {name: i for i, name in enumerate(["bias", *(f"in:{e}" for e in ELEMENTS), *(f"hint:{h}" for h in HINTS), *(f"own:{h}" for h in HINTS), "hidden", "header-of-article", *DENSITY, LOOSE, LINKED, ALIKE, OUTSIDE, *SHAPES])}


def _hints(name: str, attributes: str) -> set[str]:
    """What an element's class, id or role values hint at: ``hint`` for containers, ``own`` for single blocks."""
    found, kind = set(), "hint" if name in BOXES else "own"
    for value in _ATTRIBUTE.findall(attributes):
        for one in value.strip("\"'").split():
            parts = [x.lower() for x in _PART.findall(one)]
            if all(x in _HINT or x in PLAIN or x.isdigit() for x in parts):  # "share-bar" tells, "social-policy" does not
                found |= {f"{kind}:{_HINT[x]}" for x in parts if x in _HINT}
    if _HIDDEN.search(attributes):
        found.add("hidden")
    return found


class Ends:
    """Where raw and drawn elements of a page end, each name looked up in one pass."""

    def __init__(self, page: str):
        self.page, self.closes, self.pairs = page, {}, {}

    def raw(self, name: str, at: int) -> int:
        """Behind the next end tag; without one, the next block tag."""
        if name not in self.closes:
            self.closes[name] = [m.span() for m in re.finditer(rf"</{name}[\s/>]", self.page, re.I)]
            if "block" not in self.closes:
                self.closes["block"] = [m.start() for m in re.finditer(rf"</?(?:{'|'.join(sorted(CLOSES_P | {'body', 'head', 'li', 'td', 'tr'}))})[\s/>]", self.page, re.I)]
        found = self.closes[name]
        k = bisect.bisect_left(found, (at, at))
        if k < len(found):
            end = self.page.find(">", found[k][1] - 1)
            return end + 1 if end >= 0 else len(self.page)
        blocks = self.closes["block"]
        k = bisect.bisect_left(blocks, at)
        return blocks[k] if k < len(blocks) else len(self.page)

    def drawn(self, name: str, at: int) -> int:
        """Behind the end tag of the element whose start tag ends at ``at``; ``at`` itself without one."""
        if name not in self.pairs:
            self.pairs[name], opened = {}, []
            for m in re.finditer(rf"<(/?){name}(?=[\s/>])[^>]*>", self.page, re.I):
                if not m[1]:
                    if not m[0].endswith("/>"):
                        opened.append(m.end())
                elif opened:
                    self.pairs[name][opened.pop()] = m.end()
        return self.pairs[name].get(at, at)


class Open:
    """The open elements.  Closing one closes all inside it; each question is answered from the last places of names."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset[str], int]] = []  # name, and context and container before it
        self.places: dict[str, list[int]] = {}
        self.sections: list[int] = []
        self.blocks: list[int] = []  # places of elements that are neither inline nor paragraphs

    def push(self, name: str, context: frozenset[str], box: int) -> None:
        at = len(self.stack)
        self.stack.append((name, context, box))
        self.places.setdefault(name, []).append(at)
        if name in SECTIONS:
            self.sections.append(at)
        if name not in INLINE and name != "p":
            self.blocks.append(at)

    def _close(self, at: int) -> tuple[frozenset[str], int]:
        _, context, box = self.stack[at]
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()
        for places in (self.sections, self.blocks):
            while places and places[-1] >= at:
                places.pop()
        return context, box

    def end(self, name: str) -> tuple[frozenset[str], int] | None:
        """Close the last element of a name; not beyond the section around, unless it is one."""
        places = self.places.get(name)
        if not places or (name not in SECTIONS and self.sections and self.sections[-1] > places[-1]):
            return None
        return self._close(places[-1])

    def shut(self, name: str) -> tuple[frozenset[str], int] | None:
        """Close an element that the next start tag ends, if only inline elements and paragraphs are open in it."""
        places = self.places.get(name)
        if not places or (self.blocks and self.blocks[-1] > places[-1]):
            return None
        return self._close(places[-1])


class Boxes:
    """The containers of a page in order, with what all within each amounts to."""

    PARTS = {"div", "section", "article"}

    def __init__(self):
        self.kinds: list[tuple[int, str]] = [(0, "")]  # the container around, and the start tag
        self.headed: dict[int, str] = {}

    def add(self, around: int, tag: str) -> int:
        self.kinds.append((around, tag))
        return len(self.kinds) - 1

    def heading(self, box: int, name: str) -> None:
        self.headed[box] = min(name, self.headed.get(box, name))

    def told(self, blocks: list[tuple[int, int, int, bool]]) -> tuple[set[int], set[int]]:
        """The containers of links and those alike, with all within them, from the page's ``blocks`` in order: container,
        linked words, words, and whether it ends like a sentence."""
        n = len(self.kinds)
        links, words, count = [0] * n, [0] * n, [0] * n
        first: list[tuple[int, int, bool] | None] = [None] * n  # the first block: its place, words and end
        for i, (box, linked, size, stop) in enumerate(blocks):
            links[box] += linked
            words[box] += size
            count[box] += 1
            first[box] = first[box] or (i, size, stop)
        headed = dict(self.headed)
        for box in range(n - 1, 0, -1):  # containers stand behind those around them
            around = self.kinds[box][0]
            links[around] += links[box]
            words[around] += words[box]
            count[around] += count[box]
            if first[box] and (first[around] is None or first[box] < first[around]):
                first[around] = first[box]
            if box in headed:
                headed[around] = min(headed[box], headed.get(around, headed[box]))
        name = [tag.split(" ", 1)[0] for _, tag in self.kinds]
        bylined = [count[box] > 1 and first[box][1] <= BYLINE and not first[box][2] and box not in headed for box in range(n)]
        groups: dict[tuple[int, str], list[int]] = {}
        for box, kind in enumerate(self.kinds):
            if box and name[box] in self.PARTS:
                groups.setdefault(kind, []).append(box)
        alike = {box for group in groups.values() if len(group) > 1 and all(bylined[x] for x in group) for box in group}
        linked = {box for box in range(1, n) if name[box] in ("div", "section") and 2 * links[box] > words[box] and headed.get(box) != "h1"}
        for box in range(1, n):
            for told in (alike, linked):
                if self.kinds[box][0] in told:
                    told.add(box)
        return linked, alike


def walk(page: str, boxes: Boxes | None = None) -> Iterator[tuple[str, frozenset[str], str, int]]:
    """The page in order: (kind, context features, value, container); kinds are text, tag (inline) and break (block)."""
    open_, boxes = Open(), boxes or Boxes()
    context: frozenset[str] = frozenset()
    at, size, box = 0, len(page), 0
    ends, pattern = Ends(page), _TAG
    while at < size:
        m = _OPENS.search(page, at)
        start = m.start() if m else size
        if start > at:
            yield "text", context, page[at:start], box
        if not m:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        tag = pattern.match(page, start) if page[start + 1] not in "!?" and page[start + 1 : start + 3] != "/>" else None
        if not tag:
            end = page.find(">", start)
            if end < 0:  # cut off
                return
            pattern = _LOOSE if pattern is _TAG and page[start + 1] not in "!?" else pattern  # quotes that never close
            tag = pattern.match(page, start) if page[start + 1] not in "!?" else None
            if not tag:
                at = end + 1
                continue
        at = tag.end()
        name, kind = tag[2].lower(), "tag" if tag[2].lower() in INLINE else "break"
        if tag[1]:
            context, box = open_.end(name) or (context, box)
            yield kind, context, name, box
            continue
        yield kind, context, name, box
        if name in VOID:
            continue
        if name in RAW:
            at = ends.raw(name, at)
            continue
        if name in DRAWN:
            if not tag[3].endswith("/"):
                at = ends.drawn(name, at)
            continue
        if name in CLOSES_P or name in ("li", "tr", "td", "th", "dt", "dd", "option"):
            context, box = open_.shut("p" if name in CLOSES_P else name) or (context, box)
        inside = _hints(name, tag[3]) if tag[3] else set()
        if f"in:{name}" in FEATURES:
            inside.add(f"in:{name}")
        if name == "header" and "in:article" in context:
            inside = (inside - {"in:header", "hint:edge"}) | {"header-of-article"}
        if name == "body" or name == "html":
            inside = set()
        if name == "article" and "hint:comment" not in inside | context:
            inside.discard("hint:ad")
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            boxes.heading(box, name)
        open_.push(name, context, box)
        if name in BOXES:
            box = boxes.add(box, f"{name} {tag[3].strip()}")
        if not inside <= context:
            context = context | inside


def tokens(page: str) -> Iterator[tuple[str, frozenset[str], str]]:
    """``walk`` without the containers."""
    return (x[:3] for x in walk(page))


def _share(part: int, whole: int) -> int:
    """0 for no links, 1 for some, 2 for most words."""
    return 0 if not part else 1 if 2 * part <= whole else 2


class Piece:
    """A token with what the model reads: its place, and for texts their block's shape."""

    __slots__ = ("kind", "value", "words", "place", "shape", "box")

    def __init__(self, kind: str, value: str, words: int, place: frozenset[str], box: int):
        self.kind, self.value, self.words, self.place, self.box = kind, value, words, place, box
        self.shape: frozenset[str] = frozenset()


def _shape(block: list[Piece]) -> frozenset[str]:
    """What a block's shape tells; nothing inside an article or main element, whose short blocks are content too."""
    if any(FRAMES & x.place for x in block):
        return frozenset()
    words, links = sum(x.words for x in block), sum(x.words for x in block if "in:a" in x.place)
    found = {f"words:{n}" for n in (24, 9, 3) if words <= n} | {("", "links:some", "links:most")[_share(links, words)]}
    last = next((x.value.rstrip() for x in reversed(block) if x.words), "")
    if _STOP.search(last[-8:]):
        found.add("stop")
    return frozenset(found - {""})


def pieces(page: str) -> list[Piece]:
    """The page's tokens with their features, character references in texts decoded."""
    out: list[Piece] = []
    counts: dict[int, list[int]] = {}  # of each container's own words and blocks: linked words, words, blocks, sentences
    block: list[Piece] = []

    def close() -> None:
        if not block:
            return
        shape = _shape(block)
        count = counts[block[0].box]
        count[2] += 1
        count[3] += "stop" in shape or bool(FRAMES & block[0].place)
        last = next(x.value.rstrip() for x in reversed(block) if x.words)
        blocks.append((block[0].box, sum(x.words for x in block if "in:a" in x.place), sum(x.words for x in block), bool(_STOP.search(last[-8:]))))
        for x in block:
            x.shape = shape
        block.clear()

    boxes, blocks = Boxes(), []
    for kind, context, value, box in walk(page, boxes):
        if kind == "break":
            close()
        if kind == "text":
            value = html.unescape(value)
        x = Piece(kind, value, len(value.split()) if kind == "text" else 0, context, box)
        out.append(x)
        if x.words:
            count = counts.setdefault(box, [0, 0, 0, 0])
            count[0] += x.words if "in:a" in context else 0
            count[1] += x.words
            block.append(x)
    close()
    told: dict[int, frozenset[str]] = {}
    linked, alike = boxes.told(blocks)
    for box, (links, words, own, stops) in counts.items():
        told[box] = frozenset({("", *DENSITY)[_share(links, words)], LOOSE if own > 1 and not stops else "", LINKED if box in linked else "", ALIKE if box in alike else ""} - {""})
    framed = sum(x.words for x in out if FRAMES & x.place and "hint:comment" not in x.place)
    apart = framed >= LEAST_FRAMED and 3 * framed >= sum(x.words for x in out if not FRAMES & x.place)
    merged: dict[tuple[frozenset[str], frozenset[str]], frozenset[str]] = {}
    for x in out:
        more = told.get(x.box, frozenset())
        if apart and not FRAMES & x.place:
            more = more | {OUTSIDE}
        if more:
            key = (x.place, more)
            if key not in merged:
                merged[key] = x.place | more
            x.place = merged[key]
    return out


def labelled_pages(n: int = 600, seed: int = 7) -> Iterator[tuple[str, list[bool]]]:
    """Composed pages: (html, for each of its words whether it is content), in many layouts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ba", "ko", "ri", "tel", "um", "san", "de", "lo")) for _ in range(r.randint(1, 3)))

    for _ in range(n):
        out: list[str] = []
        labels: list[bool] = []
        telling = r.random() < 0.5  # whether class names tell anything on this page

        def text(k: int, content: bool, labels=labels) -> str:
            labels.extend([content] * k)
            return " ".join(word() for _ in range(k))

        def prose(k: int, content: bool, text=text) -> str:
            return text(k, content) + r.choice((".", ".", ".", "!", "?", ""))

        def named(*names: str, telling=telling) -> str:
            return f' class="{r.choice(names) if telling else r.choice(("c", "x", "bx", "u")) + str(r.randint(1, 99))}"'

        def odd(telling=telling) -> str:
            """Now and then a name on a block of the article that misleads."""
            return f' class="{r.choice(("lead search-tips", "intro-banner", "note alert", "side-note", "reader", "top header"))}"' if r.random() < 0.08 else ""

        def head(k: int, content: bool, name: str = "", text=text) -> str:
            level = r.randint(2, 4)
            return f"<h{level}{name}>" + text(k, content) + f"</h{level}>"

        def link(k: int, text=text) -> str:
            return "<a href=x>" + text(k, False) + "</a>"

        frame = r.choice(("article", "main", f"div{named('content', 'post-body', 'story')}", f"div{named('main', 'entry')}", "div", "section"))
        apart = frame in ("article", "main")  # what stands outside is none of it, whatever it looks like

        def junk(framed: bool = False, apart=apart, out=out, text=text, prose=prose, named=named, head=head, link=link, telling=telling) -> None:
            kind = r.choice(("ad", "side", "comment", "notice", "form", "share", "aside", "related", "hidden", "shop", "menu"))
            if framed and not telling and kind in ("ad", "side", "notice", "share", "shop"):
                kind = r.choice(("form", "aside", "hidden", "related", "menu"))  # within an article only structure tells
            if apart and not framed and r.random() < 0.4:
                some = [prose(r.randint(4, 40), False) for _ in range(r.randint(1, 4))]
                each = r.choice(("<p>{}</p>", "<ul><li><p>{}</p></li></ul>", "<div class=u>{}</div>", "<div class=u><p>{}</p></div>", "<section><p>{}</p></section>"))
                out.append("".join(each.format(x) for x in some))
            elif kind == "form":
                out.append("<form><label>" + text(2, False) + "</label><input><button>" + text(1, False) + "</button></form>")
            elif kind == "aside":
                out.append("<aside>" + head(2, False) + "<p>" + prose(r.randint(4, 30), False) + "</p></aside>")
            elif kind == "hidden":
                out.append('<div style="display:none"><p>' + prose(r.randint(4, 20), False) + "</p></div>")
            elif kind == "comment" and not telling:
                each = r.choice(("div", "div", "section"))
                one = lambda: f"<{each} class=u><b>" + text(r.randint(1, 2), False) + "</b><p>" + prose(r.randint(5, 30), False) + f"</p></{each}>"
                out.append("<div class=c>" + (head(1, False) if r.random() < 0.5 else "") + "".join(one() for _ in range(r.randint(2, 4))) + "</div>")
            elif kind == "comment":
                out.append('<section class="comments">' + head(1, False) + "".join('<article class="comment"><p>' + prose(r.randint(5, 30), False) + "</p></article>" for _ in range(r.randint(1, 3))) + "</section>")
            elif kind == "related":
                out.append(f"<div{named('related', 'menu', 'trending')}>" + head(2, False) + "<ul>" + "".join("<li>" + link(r.randint(3, 9)) + "</li>" for _ in range(r.randint(3, 6))) + "</ul></div>")
            elif kind == "menu":
                out.append(f"<div{named('nav', 'breadcrumbs', 'tabs')}>" + r.choice((" ", "<br>")).join(link(r.randint(1, 2)) for _ in range(r.randint(3, 9))) + "</div>")
            elif kind == "shop" or (not telling and kind in ("ad", "side", "notice", "share")):
                out.append(f"<div{named('promo', 'widget', 'sponsored')}>" + "".join("<p>" + text(r.randint(1, 4), False) + ("" if r.random() < 0.5 else " " + link(2)) + "</p>" for _ in range(r.randint(2, 5))) + "</div>")
            else:
                names = {"ad": ("ad", "advert"), "side": ("sidebar", "widget"), "notice": ("cookie-notice", "newsletter"), "share": ("share", "social")}[kind]
                out.append(f"<div{named(*names)}><p>" + prose(r.randint(3, 30), False) + "</p></div>")

        out.append("<html><head><title>x</title></head><body>")
        if r.random() < 0.7:
            out.append("<header><p>" + text(r.randint(1, 12), False) + "</p></header>")
        items = "".join("<li>" + link(1) + "</li>" for _ in range(r.randint(2, 8)))
        out.append(f"<nav><ul>{items}</ul></nav>" if r.random() < 0.6 else f"<div{named('menu', 'navbar')}><ul>{items}</ul></div>")
        for _ in range(r.randint(0, 2)):
            junk()
        wrapped = r.choice((0, 0, 1, 2))
        out.append(f"<{frame}>" + "<div class=w>" * wrapped + "<h1>" + text(r.randint(3, 9), True) + "</h1>")
        if frame == "article" and r.random() < 0.3:
            out.append("<header><p>" + text(4, True) + "</p></header>")
        plain = r.choice(("p", "p", "p", "div"))  # what paragraphs are made of
        for _ in range(r.randint(3, 9)):
            pick = r.random()
            if pick < 0.66 and plain == "div":
                out.append("<div class=g>" + prose(r.choice((r.randint(2, 12), r.randint(8, 60))), True) + "</div>")
            elif pick < 0.66:
                out.append(f"<p{odd()}>" + prose(r.choice((r.randint(2, 12), r.randint(8, 60), r.randint(20, 60))), True) + r.choice(("</p>", "")))
            elif pick < 0.72:
                out.append("<p>" + text(r.randint(8, 30), True) + " <a href=x>" + text(r.randint(1, 5), True) + "</a> " + prose(r.randint(4, 20), True) + "</p>")
            elif pick < 0.78:
                out.append("<ul>" + "".join("<li>" + prose(r.randint(3, 12), True) + "</li>" for _ in range(3)) + "</ul>")
            elif pick < 0.86:
                out.append(head(r.randint(2, 6), True, odd()) + "<p>" + prose(r.randint(5, 40), True) + "</p>")
            elif pick < 0.89:
                if r.random() < 0.5:
                    out.append("<ul>" + "".join("<li><a href=x>" + text(r.randint(2, 9), True) + "</a></li>" for _ in range(r.randint(3, 10))) + "</ul>")
                else:
                    part = r.choice(("section", "div"))
                    out.append("".join(f"<{part}{odd()}>" + head(r.randint(1, 4), True) + "<p>" + prose(r.randint(5, 40), True) + f"</p></{part}>" for _ in range(r.randint(1, 3))))
            elif pick < 0.93:
                out.append("<blockquote><p>" + prose(r.randint(5, 25), True) + "</p></blockquote><table><tr><td>" + text(2, True) + "</td></tr></table>")
            else:
                junk(frame in ("article", "main"))
        out.append("<p>" + prose(r.randint(12, 40), True) + "</p>" + "</div>" * wrapped + f"</{frame.split()[0]}>")
        for _ in range(r.randint(0, 2)):
            junk()
        foot = ("<p>" + text(r.randint(3, 12), False) + "</p>" if r.random() < 0.7 else text(r.randint(1, 4), False)) + " ".join(link(1) for _ in range(r.randint(0, 3)))
        out.append((f"<footer>{foot}</footer>" if r.random() < 0.7 else f"<div{named('footer', 'legal')}>{foot}</div>") + "</body></html>")
        yield "".join(out), labels


class Model:
    """Word and tag scores.  ``weights`` by feature; ``tag`` for inline and ``block`` for block tags."""

    def __init__(self, weights: np.ndarray, tag: float, block: float):
        self.weights, self.tag, self.block = weights, tag, block
        self._known: dict[frozenset[str], float] = {}

    def sum(self, features: frozenset[str]) -> float:
        if features not in self._known:
            self._known[features] = float(sum(self.weights[FEATURES[f]] for f in features))
        return self._known[features]

    def place(self, x: Piece) -> float:
        """A word's score for its place alone."""
        return self.sum(x.place) + self.weights[0]

    def word(self, x: Piece) -> float:
        return self.place(x) + self.sum(x.shape)


def learn(pages: Iterator[tuple[str, list[bool]]], steps: int = 400) -> Model:
    """Fit the word model by logistic regression (weight decay, full batches); tags cost what they tell against content."""
    seen: dict[frozenset[str], list[float]] = {}
    tags = {"tag": [1, 1], "break": [1, 1]}
    for page, labels in pages:
        at = 0
        for x in pieces(page):
            if x.kind == "text":
                for _ in range(x.words):
                    seen.setdefault(x.place | x.shape, [0, 0])[labels[at]] += 1
                    at += 1
            else:
                inside = 0 < at < len(labels) and labels[at - 1] and labels[at]
                tags[x.kind][inside] += 1
    rows = np.zeros((len(seen), len(FEATURES)))
    rows[:, 0] = 1
    for i, features in enumerate(seen):
        rows[i, [FEATURES[f] for f in features]] = 1
    y = np.array(list(seen.values()), float)
    total = y.sum(axis=1)
    w = np.zeros(len(FEATURES))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        hess = (rows.T * (p * (1 - p) * total + 1e-9)) @ rows + np.eye(len(w)) * 0.5
        step = np.linalg.solve(hess, rows.T @ (y[:, 1] - p * total) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    cost = {k: -max(0.05, min(1.0, float(np.log(out / inside) if out > inside else 0.05))) for k, (out, inside) in tags.items()}
    return Model(w, cost["tag"] * 0.1, cost["break"] * 0.25)


_model: list[Model] = []


def default_model() -> Model:
    if not _model:
        _model.append(learn(labelled_pages()))
    return _model[0]


def best_run(gains: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum, as (first, behind the last); empty if no sum is positive.

    A linear scan: a sum that is not positive is dropped, and of equal sums the first is kept.
    """
    best = total = 0.0
    first = start = last = 0
    for i, gain in enumerate(gains):
        if total <= 0:
            total, start = 0.0, i
        total += gain
        if total > best:
            best, first, last = total, start, i + 1
    return first, last


def gains_of(page: list[Piece], model: Model) -> list[float]:
    """What each token adds to a run's sum: words their scores, tags their costs, rejected blocks ``BRIDGE`` at most."""
    out = []
    left, frames = BRIDGE, frozenset()  # what rejected blocks may still cost, and the frames of the last content
    for x in page:
        gain = model.word(x) * x.words if x.kind == "text" else model.tag if x.kind == "tag" else model.block
        if model.place(x) <= 0 or (x.words and gain <= 0):
            if frames <= x.place:
                gain = max(gain, -left)
                left += gain
        elif x.words and gain > 0:
            left, frames = BRIDGE, FRAMES & x.place
        out.append(gain)
    return out


def extract(page: str | None, model: Model | None = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    model = model or default_model()
    rows = pieces(page)
    first, last = best_run(gains_of(rows, model))
    out: list[str] = []
    for x in rows[first:last]:
        if x.kind == "break":
            out.append(" ")
        elif x.kind == "text":
            out.append(x.value if model.place(x) > 0 else " ")
    return " ".join("".join(out).split())


def _extracted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [extract(p, model) for p in part.column("html").to_pylist()]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars (code points)."""
    rows = light_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted(model or default_model()), "page_id long, url string, text string, n_chars long")
