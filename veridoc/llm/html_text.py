"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser is fed a page in chunks. Its events become lines: the text
between two block boundaries, with the tags met on the way, the part inside links and the
element that holds it. Lines inside elements that say they are no content (menus, footers,
adverts, forms, comments, hidden parts) count as lines without text. The ratio of characters
to tags per line is smoothed by a Gaussian, and lines above a share of the standard deviation
are the clusters of content. They decide the regions:

* articles (or main elements), if these hold most of the clusters' text: all of them;
* else the lowest element that holds all clusters, and what it is only a part of: a list, a
  table, a quotation, one of like sections. Of its branches, those before the first and after
  the last cluster stay only if they are text by their element, or like a branch with a cluster.

All lines of a region are the result, but rows of links. So short paragraphs and a paragraph
that is one link stay. What the names of elements would hide altogether is looked at again
without names.

A null or empty page, and a page without visible text, gives an empty string. The whole page
is read, in time that grows with its length however deep or broken it is; nothing is
shuffled. Equal pages give equal texts. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import operator
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from veridoc.llm.common import with_columns

CHUNK = 1 << 16
#: Radius and standard deviation of the smoothing, in lines; seeds lie above this part of the deviation.
RADIUS, SIGMA, SEED_DEVIATIONS = 2, 1.0, 0.5
#: A line is a link if more than this part of it is; so many links beside each other are a menu.
MAX_LINK_SHARE, MENU = 0.66, 3
#: Articles are the region if they hold this part of the clusters' text.
MOST = 0.5

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never content, whatever stands in them.
SKIPPED = frozenset("head script style noscript template svg iframe object applet audio video canvas map nav footer aside form button select textarea datalist dialog menu".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip status".split())
#: Words of class names and ids that say the same, if no other words but neutral ones stand beside them.
SKIPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense adbox banner banners alert alerts breadcrumb breadcrumbs captcha comment comments commentlist cookie cookies consent disclaimer discussion disqus footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promos promotion recommended related replies reply respond share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar tooltip topbar widget widgets".split()
)
NEUTRAL_NAMES = frozenset("area bar block body bottom box button buttons center column container content element entry fixed float group holder inner item items js layout left link links list main module more new off open outer page panel popular position post posts right row section site small sticky text title top wide wrap wrapper".split())
#: A header that names one of these, or stands in an article, is the article's own.
OWN_HEADER = frozenset("article content entry page post story title".split())
#: Elements that are never skipped for their names.
ROOTS = frozenset("html body main article".split())
SCOPES = frozenset("html body main article section div td center blockquote ul ol dl table tbody tr li details figure".split())
#: Elements that are part of a text, never the whole of it.
PARTS = frozenset("blockquote ul ol li dl table tbody tr td details figure".split())
#: Branches of a region that hold anything else than text.
HOLDERS = frozenset("div section center ul ol table tbody tr td article".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_BARRIER = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote td th li fieldset".split())
#: Elements that hold items; elements that hold text.
_LISTS = ("table", "ul", "ol", "dl", "select", "html")
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption li address summary".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")


class Line:
    __slots__ = ("parts", "tags", "links", "n_links", "element", "skipped", "number", "within")

    def __init__(self, number: int):
        self.parts, self.tags, self.links, self.n_links, self.number = [], 0, 0, 0, number


class Element:
    """An element that can be a region: its lines are those from ``first`` up to ``end``."""

    __slots__ = ("name", "classes", "parent", "first", "end")

    def __init__(self, name: str, classes: str, parent: Element | None, first: int):
        self.name, self.classes, self.parent, self.first, self.end = name, classes, parent, first, 1 << 60

    def holds(self, line: Line) -> bool:
        return self.first <= line.number < self.end


class Events(HTMLParser):
    """Lines of a page from start tags, end tags and text, as they come. Where open elements are is kept by name, so no event walks the stack."""

    def __init__(self, by_name: bool = True):
        super().__init__(convert_charrefs=True)
        self.by_name = by_name
        self.elements: list[Element] = []
        #: name, whether it is skipped, the nearest element that can be a region, whether it is that element
        self.stack: list[tuple[str, bool, Element | None, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.lines = [Line(0)]
        self.break_line()

    def open(self, tag: str) -> int:
        """The place of the innermost open element of that name, -1 if there is none."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def break_line(self) -> None:
        if self.lines[-1].parts:  # if nothing is said yet, its tags go on to the next
            self.lines.append(Line(len(self.lines)))
        line = self.lines[-1]
        line.skipped, line.element = self.stack[-1][1:3] if self.stack else (False, None)
        line.within = self.stack[-1][0] if self.stack else ""

    def _skips(self, tag: str, attrs) -> bool:
        if tag in SKIPPED and (self.by_name or tag != "form"):  # a form round the whole page is no form
            return True
        inside = self.open("article") >= 0 or self.open("main") >= 0
        if tag == "header" and not inside:
            return True
        found = {k: v or "" for k, v in attrs}
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
            return True
        if not self.by_name:
            return False
        if tag in ROOTS and not (tag == "article" and any(x.lower() in ("comment", "teaser", "related", "promo", "ad") for x in _NAME.findall(found.get("class", "")))):
            return False
        if found.get("role", "").lower() in SKIPPED_ROLES:
            return True
        names = [{w.lower() for w in _NAME.findall(x)} for x in f"{found.get('class', '')} {found.get('id', '')}".split()]
        own = inside or any(words & OWN_HEADER for words in names)
        no_content = SKIPPED_NAMES - {"header", "masthead"} if own else SKIPPED_NAMES
        return any(words & no_content and words <= SKIPPED_NAMES | NEUTRAL_NAMES for words in names)

    def _push(self, tag: str, attrs) -> None:
        skipped = bool(self.stack) and self.stack[-1][1] or self._skips(tag, attrs)
        element, region = self.stack[-1][2] if self.stack else None, tag in SCOPES
        if region:
            element = Element(tag, " ".join(sorted((dict(attrs).get("class") or "").split())), element, len(self.lines) - (not self.lines[-1].parts))
            self.elements.append(element)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _BARRIER:
            self.barriers.append(len(self.stack))
        self.stack.append((tag, skipped, element, region))

    def _pop_from(self, place: int) -> None:
        end = len(self.lines) - (not self.lines[-1].parts)
        for name, _, element, region in self.stack[place:]:
            self.places[name].pop()
            if name in _BARRIER:
                self.barriers.pop()
            if region:
                element.end = end
        del self.stack[place:]

    def _close(self, tags, barrier: int) -> None:
        """Close the innermost open element of one of the names, if it stands after the barrier."""
        place = max(map(self.open, tags))
        if place > barrier or place == barrier >= 0:
            self._pop_from(place)

    def handle_starttag(self, tag, attrs):
        last = self.barriers[-1] if self.barriers else -1
        if tag in BLOCKS:
            self._close(("p",), last)
        if tag in _CLOSED_BY:
            self._close(_CLOSED_BY[tag], -1 if tag == "body" else max(map(self.open, _LISTS)))
        if tag == "a":
            self._close(("a",), self.barriers[-1] if self.barriers else -1)
        if tag not in VOID:
            self._push(tag, attrs)
        if tag in BLOCKS or tag in ("td", "th") and self.stack[-1][1]:
            self.break_line()
        elif self.stack and self.stack[-1][1] != self.lines[-1].skipped:
            self.break_line()
        elif tag in ("br", "td", "th"):
            self.lines[-1].parts.append(" ")
        self.lines[-1].tags += 1
        self.lines[-1].n_links += tag == "a"

    handle_startendtag = handle_starttag  # as browsers do: the slash means nothing

    def handle_endtag(self, tag):
        self.lines[-1].tags += 1
        if tag in VOID:
            return
        before = bool(self.stack) and self.stack[-1][1]
        self._close((tag,), -1 if tag in BLOCKS or not self.barriers else self.barriers[-1])
        if tag in BLOCKS or before != (bool(self.stack) and self.stack[-1][1]):
            self.break_line()
        elif tag in ("td", "th"):
            self.lines[-1].parts.append(" ")

    def handle_data(self, data):
        line = self.lines[-1]
        line.parts.append(data)
        if self.open("a") >= 0:
            line.links += len(data.strip())


def events(html: str, by_name: bool = True) -> Events:
    e = Events(by_name)
    for k in range(0, len(html), CHUNK):
        e.feed(html[k : k + CHUNK])
    # a tag that the page's end cuts off is none; the parser would look for its end again and again
    if m := _UNFINISHED.search(e.rawdata):
        e.rawdata = e.rawdata[: m.start()]
    e.close()
    return e


def smooth(values: list[float]) -> list[float]:
    """A Gaussian of the stated radius; weights beyond either end are left out."""
    kernel = [math.exp(-0.5 * (k / SIGMA) ** 2) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        part = [(values[i + k], w) for k, w in zip(range(-RADIUS, RADIUS + 1), kernel) if 0 <= i + k < len(values)]
        out.append(sum(v * w for v, w in part) / sum(w for _, w in part))
    return out


class Said:
    """The lines of a page that say something, with what decides about them."""

    def __init__(self, e: Events):
        self.elements = e.elements
        said = [(x, t) for x in e.lines if x.parts and (t := " ".join("".join(x.parts).split()))]
        self.lines, self.texts = [x for x, _ in said], [t for _, t in said]
        self.open = [not x.skipped for x in self.lines]
        linked = [x.links > MAX_LINK_SHARE * len(t) for x, t in said]
        # a menu is a row of links, in one line or in several
        self.menu, run = [False] * len(said), []
        for i, (x, _) in enumerate([*said, (None, "")]):
            if x is not None and linked[i] and self.open[i]:
                run.append(i)
                continue
            if sum(max(1, self.lines[k].n_links) for k in run) >= MENU:
                for k in run:
                    self.menu[k] = True
            run = []
        ratio = smooth([len(t) / max(1, x.tags) if o and not m else 0.0 for (x, t), o, m in zip(said, self.open, self.menu)])
        mean = sum(ratio) / max(1, len(ratio))
        threshold = SEED_DEVIATIONS * math.sqrt(sum((r - mean) ** 2 for r in ratio) / max(1, len(ratio)))
        could = [i for i in range(len(said)) if self.open[i] and not linked[i]]
        self.seeds = [i for i in could if ratio[i] >= threshold] or could
        self.live = [o and not m for o, m in zip(self.open, self.menu)]

    def outermost(self, name: str) -> list[Element]:
        """The elements of that name with open lines that stand in no other of it."""
        out: list[Element] = []
        for el in self.elements:  # in page order
            if el.name == name and not (out and el.first < out[-1].end and el.end <= out[-1].end):
                out.append(el)
        return out

    def span(self, el: Element | None, which: list[int]) -> tuple[int, int]:
        """Where those of ascending lines begin and end that the element holds; None is the whole page."""
        if el is None:
            return 0, len(which)
        number = lambda i: self.lines[i].number
        return bisect.bisect_left(which, el.first, key=number), bisect.bisect_left(which, el.end, key=number)

    def of(self, el: Element | None, which: list[int]) -> list[int]:
        return which[slice(*self.span(el, which))]

    def regions(self) -> list[int]:
        """The lines of the regions, in page order."""
        every = [i for i, live in enumerate(self.live) if live]
        if not self.seeds:
            return []
        weight = lambda which: sum(len(self.texts[i]) for i in which)
        for name in ("article", "main"):
            found = [el for el in self.outermost(name) if self.of(el, every)]
            held = sorted({i for el in found for i in self.of(el, self.seeds)})
            if held and weight(held) >= MOST * weight(self.seeds):
                return sorted({i for el in found for i in self.of(el, every)})
        return self.around(every)

    def around(self, every: list[int]) -> list[int]:
        """The lines of the lowest element that holds all clusters, or of what it is part of, without branches at its ends that are no text."""
        first, last = self.lines[self.seeds[0]], self.lines[self.seeds[-1]]
        el = first.element
        while el is not None and not el.holds(last):
            el = el.parent
        live = [x for x in self.elements if operator.lt(*self.span(x, every))]
        kinds = Counter((id(x.parent), x.name, x.classes) for x in live)
        while el is not None and el.name not in ("body", "html"):
            beside = self.span(el.parent, every) != self.span(el, every)
            like = kinds[id(el.parent), el.name, el.classes] > 1
            if beside and not like and el.name not in PARTS:
                break
            el = el.parent
        inside = self.of(el, every)
        while el is None or el.name == "html":  # branches are those of the body, if there is one
            body = next((x for x in live if x.parent is el and x.name in ("html", "body")), None)
            if body is None:
                break
            el = body
        branches = [x for x in live if x.parent is el and x.name in HOLDERS]
        with_seed = [x for x in branches if operator.lt(*self.span(x, self.seeds))]
        like = {(x.name, x.classes) for x in with_seed}
        out = set(inside)
        for x in branches:
            lines = self.of(x, every)
            end = lines[-1] < self.seeds[0] or lines[0] > self.seeds[-1]
            if end and not ((x.name, x.classes) in like and any(self.lines[i].within in TEXT for i in lines)):
                out -= set(lines)
        return sorted(out)


def blocks(html: str) -> list[str]:
    """The blocks of the main text, in page order."""
    said = Said(events(html))
    if said.texts and not any(said.open):
        said = Said(events(html, by_name=False))
    return [said.texts[i] for i in said.regions()]


def main_text(html: str | None) -> str:
    return "\n\n".join(blocks(html or ""))


def extract_main_text(df: DataFrame, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Append ``text`` and ``n_chars`` (code points); columns of these names are replaced."""

    def make():
        def fn(pages):
            texts = [main_text(h) for h in pages.to_pylist()]
            return [pa.array(texts, pa.large_string()), [len(t) for t in texts]]

        return fn

    return with_columns(df, column, "text string, n_chars bigint", make, keep)
