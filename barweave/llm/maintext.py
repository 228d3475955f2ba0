"""Main text of web pages by line-block distribution.

Markup is stripped into lines: every block element is a line, the border of a container is a blank line, and what
stands in menus, forms, scripts and other parts that are never running text leaves a blank line, too. A line's weight is the
number of its characters outside links, and nothing if half of it or more is links. The weights are summed over sliding windows of ``WINDOW`` lines; the
distribution surges where the running text begins and dives where it ends, and the lines between are kept.

Where a page names its article, lines outside it have no weight, so that the first surge and the last dive are the
article's own and short paragraphs stay. Elsewhere a surge must reach ``SURGE``, the heaviest stretch wins, and its ends
are moved to the borders of the smallest container that holds it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

WINDOW, SURGE = 3, 86

# fixed values: HTML elements by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("html body main article section div aside header footer nav form table tbody thead tfoot ul ol dl blockquote figure fieldset details center".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre figcaption caption summary address option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no running text wherever they stand.
DROPPED = frozenset("nav footer aside form noscript template svg math canvas object audio video button select dialog menu map head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that name such a part.
PARTS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promoted banner
    nav navbar navigation menu submenu menubar breadcrumb breadcrumbs pagination pager sidebar footer masthead toolbar
    cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay dialog
    comment comments commentlist disqus respond replies discussion
    share sharing social related recommended recommendations newsletter subscribe subscription signup login widget""".split()
)
COMMENT_PARTS = frozenset("comment comments commentlist disqus respond replies discussion".split())
#: Words before a part's name that say that the element only has one beside it, or hasn't.
BESIDE = frozenset("has with no without is js".split())
HEADER_OWNERS = frozenset("site page top global main masthead".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r"""(?:"[^"]*+"|'[^']*+'|[^"'>])*+>""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_LEGAL = re.compile(r"©|\(c\)\s|copyright|all rights reserved", re.IGNORECASE)


class Line(NamedTuple):
    """A line of the stripped page: its text, characters outside links, container and whether it is a heading."""

    text: str
    weight: int
    owner: int
    heading: bool


class Page(NamedTuple):
    """Lines in page order, the parent of each container, and the containers that are articles or main parts."""

    lines: list[Line]
    parents: list[int]
    names: list[str]


def attributes(tag: str) -> dict[str, str]:
    """The attributes that tell a part, by lower-case name."""
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(tag)}


def part_words(names: str) -> set[str]:
    """The words of classes and ids, without names that only say what stands beside."""
    out: set[str] = set()
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] not in BESIDE:
            out.update(words)
            if "header" in words and (len(words) == 1 or words[0] in HEADER_OWNERS):
                out.add("#header")
    return out


def is_dropped(name: str, tag: str, inside: bool) -> bool:
    """Whether an element with all in it is no running text; ``inside``: it stands in an article or main part."""
    if name in ("html", "body", "main"):
        return False
    if name in DROPPED or name == "header" and not inside:
        return True
    if "=" not in tag and "hidden" not in tag:
        return False
    a = attributes(tag)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.IGNORECASE):
        return True
    words = part_words(f"{a.get('class', '')} {a.get('id', '')}")
    if name == "article":
        return bool(words & COMMENT_PARTS)
    return a.get("role", "").lower() in ROLES or bool(words & PARTS) or "#header" in words and not inside


class _Stripper:
    """Reads a page once from left to right; the state is the open elements and the current line."""

    def __init__(self):
        self.lines, self.parents, self.names = [], [-1], [""]
        self.open: list[tuple[str, int, bool]] = []  # name, container, whether it began a dropped part
        self.counts: dict[str, int] = {}
        self.at, self.skipped, self.comments, self.links, self.named = 0, 0, 0, 0, 0
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.heading = False

    def text(self, raw: str) -> None:
        if not self.skipped:
            raw = entities.unescape(raw) if "&" in raw else raw
            self.pieces.append(raw)
            if self.links:
                self.linked.append(raw)

    def line(self, blank: bool = False) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                linked = len(" ".join("".join(self.linked).split())) if self.linked else 0
                self.lines.append(Line(text, len(text) - linked if 2 * linked < len(text) else 0, self.at, self.heading))
            self.pieces, self.linked = [], []
        if blank:
            self.lines.append(Line("", 0, self.at, False))

    def pop(self) -> None:
        name, container, dropped = self.open.pop()
        self.counts[name] -= 1
        self.skipped -= dropped
        self.comments -= dropped and name == "#comments"
        if name in ("article", "main"):
            self.named -= 1
        if name in HEADINGS:
            self.heading = False
        self.at = container

    def start(self, name: str, tag: str) -> None:
        if name in INLINE:
            if name == "a" and not tag.endswith("/"):
                self.links = 1
            elif name == "br":
                self.text(" ")
            if name not in VOID and ("class" in tag or "hidden" in tag or "role" in tag or "style" in tag) and is_dropped(name, tag, self.named > 0):
                self.push(name, True)
            return
        if name in VOID:
            if name == "hr":
                self.line(True)
            return
        for leaf in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):  # a block ends an open paragraph, an item the item before
            if self.counts.get(leaf) and (leaf == "p" or leaf == name or leaf in ("td", "th") and name in ("td", "th", "tr")) and self._near(leaf):
                self.end(leaf)
        self.line(name in CONTAINERS)
        drop = is_dropped(name, tag, self.named > 0)
        if name in ("article", "main") and not drop and self.skipped and not self.comments:
            while self.skipped:  # the part before it was never closed
                self.pop()
        if tag.endswith("/") and name in ("svg", "math", "object", "canvas"):
            return
        self.push(name, drop, tag)

    def _near(self, leaf: str) -> bool:
        """Whether the open ``leaf`` belongs to the innermost container."""
        for name, *_ in reversed(self.open):
            if name == leaf:
                return True
            if name in CONTAINERS or name in DROPPED:
                return False
        return False

    def push(self, name: str, drop: bool, tag: str = "") -> None:
        self.open.append((name, self.at, drop))
        self.counts[name] = self.counts.get(name, 0) + 1
        if drop:
            self.skipped += 1
            a = attributes(tag)
            if part_words(f"{a.get('class', '')} {a.get('id', '')}") & COMMENT_PARTS:
                self.open[-1] = ("#comments", self.at, True)
                self.counts[name] -= 1
                self.counts["#comments"] = self.counts.get("#comments", 0) + 1
                self.open[-1:-1] = [(name, self.at, False)]  # closed by its own end tag
                self.counts[name] += 1
                self.comments += 1
        if name in ("article", "main"):
            self.named += 1
        if name in CONTAINERS:
            self.parents.append(self.at)
            self.names.append(name)
            self.at = len(self.parents) - 1
        if name in HEADINGS:
            self.heading = True

    def end(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if not self.counts.get(name):
            return
        if name not in INLINE:
            self.line(name in CONTAINERS)
        while self.open:
            last = self.open[-1][0]
            self.pop()
            if last == name:
                break

    def run(self, page: str) -> Page:
        at, n, quoted = 0, len(page), True
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.text(page[at:])
                break
            if lt > at:
                self.text(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            m = _NAME.match(page, lt + 1)
            if not m:
                if page.startswith(("<!", "<?", "</"), lt):
                    end = page.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self.text("<")
                    at = lt + 1
                continue
            close = _TAG_END.match(page, m.end()) if quoted else None
            if close:
                end = close.end()
            else:  # a quote that never ends: from here on tags end at the next >
                quoted, end = False, page.find(">", m.end()) + 1
                if not end:
                    break
            name, tag = m[1].lower(), page[m.end() : end - 1]
            at = end
            if page[lt + 1] == "/":
                self.end(name)
                continue
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = n if not stop else page.find(">", stop.end()) + 1 or n
                if name not in ("title", "style", "script"):
                    self.line()
                continue
            self.start(name, tag)
        self.line()
        return Page(self.lines, self.parents, self.names)


def strip(page: str) -> Page:
    return _Stripper().run(page)


def _masses(page: Page) -> list[int]:
    """Characters outside links in each container with all in it."""
    mass = [0] * len(page.parents)
    for x in page.lines:
        mass[x.owner] += x.weight
    for c in range(len(mass) - 1, 0, -1):  # parents come before children
        mass[page.parents[c]] += mass[c]
    return mass


def _within(page: Page, root: int) -> list[bool]:
    """Whether each container is ``root`` or inside it."""
    out = [False] * len(page.parents)
    for c in range(len(out)):
        out[c] = c == root or c > 0 and out[page.parents[c]]
    return out


def _article(page: Page, mass: list[int]) -> int | None:
    """The article of the page: the heaviest one, or the main part if it has more than twice as much."""
    best = {kind: max((c for c, name in enumerate(page.names) if name == kind and mass[c]), key=lambda c: mass[c], default=None) for kind in ("article", "main")}
    article, main = best["article"], best["main"]
    if article is None or main is not None and mass[main] > 2 * mass[article]:
        return main
    return article


def stretches(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """Line ranges from a surge to its dive: where sums over ``window`` lines reach ``surge`` and until they fall to nothing."""
    n, total, out, start = len(weights), 0, [], None
    sums = []
    for i in range(n + window - 1):  # the window that ends at line i
        total += weights[i] if i < n else 0
        total -= weights[i - window] if i >= window else 0
        sums.append(total)
    for i, s in enumerate(sums):
        if start is None and s >= surge:
            start = i
            while start > 0 and sums[start - 1] > 0:  # the rise before the surge belongs to it
                start -= 1
        elif start is not None and s == 0:
            out.append((start, i - window + 1))
            start = None
    if start is not None:
        out.append((start, n))
    return out


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page: its blocks joined by line feeds, empty if there is none."""
    p = strip(page)
    mass = _masses(p)
    root = _article(p, mass)
    if root is not None:
        inside = _within(p, root)
        weights = [len(x.text) if inside[x.owner] else 0 for x in p.lines]
        found = stretches(weights, window, 1)
        if not found:
            return ""
        lo, hi = found[0][0], found[-1][1]
        return "\n".join(x.text for x in p.lines[lo:hi] if x.text and inside[x.owner])
    weights = [x.weight for x in p.lines]
    found = stretches(weights, window, surge)
    if not found:
        return ""
    lo, hi = max(found, key=lambda r: sum(weights[r[0] : r[1]]))
    # the ends go to the borders of the smallest container that holds the stretch
    half, root = sum(weights[lo:hi]) / 2, 0
    held = [0] * len(mass)
    for x in p.lines[lo:hi]:
        held[x.owner] += x.weight
    for c in range(len(held) - 1, 0, -1):
        held[p.parents[c]] += held[c]
    for c in range(len(held)):
        if held[c] > half and (c == 0 or root == p.parents[c]):
            root = c
    if p.names[root] not in ("", "html", "body"):
        inside = _within(p, root)
        kept = [x for x in p.lines if x.text and inside[x.owner]]
    else:
        while lo > 0 and (p.lines[lo - 1].heading or not p.lines[lo - 1].text and lo > 1 and p.lines[lo - 2].heading):
            lo -= 1
        kept = [x for x in p.lines[lo:hi] if x.text]
    while kept and (not kept[-1].weight or _LEGAL.search(kept[-1].text) and kept[-1].weight < surge):
        kept.pop()
    while kept and not kept[0].weight and not kept[0].heading:
        kept.pop(0)
    return "\n".join(x.text for x in kept)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        found = [main_text(x or "") for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], schema=_SCHEMA)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (long): the main text of every page. No shuffle: a page is read, stripped and
    weighed by itself, in one pass over its characters.

    Defined cases: null and empty html, and pages without running text, give ``""``; null page_id and url pass
    through; repeated rows give repeated results; unclosed elements end with the element around them, an
    unclosed comment or script at the end of the page; very long pages are taken whole; white space is that of
    Unicode (no-break spaces, too); ``<br>`` is a space; an empty table gives no rows; other columns are ignored.
    """
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
