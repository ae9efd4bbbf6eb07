"""Visible text of HTML pages, laid out by blocks, lists and tables.

A tolerant tree builder closes elements whose end tags are implied; the renderer skips what a browser would not show and sets off
blocks by line breaks, list items by markers, and table cells by aligned columns.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.common import table

# Quotes delimit a value only directly after "="; an unquoted value ends at white space or ">". A tag that the page's end cuts off is no tag.
_NAME = r"[^\s/>][^\s/>=]*+"
_VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+"
_ATTRS = rf"(?:[\s/]++|{_NAME}(?:\s*+=\s*+(?:{_VALUE}))?+)*+"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*+){_ATTRS}(?:>|\Z)|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?P<shut>>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE}))?+")
_HIDING = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.IGNORECASE)
_INTEGER = re.compile(r"\s*([+-]?\d{1,10})(?!\d)")

# Element classes of the HTML standard (fixed values).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas svg math datalist select option".split())
_HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre plaintext table figure fieldset hr".split())
_BLOCKS = _SPACED | frozenset(
    "html body address article aside caption center dd details dialog div dt figcaption footer form header legend li main nav section summary tbody td tfoot th thead tr".split()
)
_CLOSES_P = _BLOCKS - frozenset("html body td th tr tbody thead tfoot caption li dd dt legend summary".split())
#: An element's start closes an open one of these, up to the nearest of those.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_WIDE = 60  # a wider cell is wrapped at spaces
_KEPT = ("start", "value", "reversed", "colspan", "rowspan", "open")


class Node:
    """An element. ``hidden`` takes it and all inside away; ``visible`` is what it says of itself and what is inside, null if it says nothing."""

    __slots__ = ("tag", "hidden", "visible", "attrs", "children")

    def __init__(self, tag: str, hidden: bool = False, visible: bool | None = None, attrs: dict[str, str] | None = None):
        self.tag, self.hidden, self.visible, self.attrs, self.children = tag, hidden, visible, attrs or {}, []

    def number(self, name: str, default: int | None, least: int = -(2**31), most: int = 2**31 - 1) -> int | None:
        """An integer attribute as browsers read it; one beyond 32 bits counts as none, others are brought into the range."""
        found = _INTEGER.match(self.attrs.get(name, ""))
        if not found or not -(2**31) <= int(found[1]) < 2**31:
            return default
        return min(max(int(found[1]), least), most)


def parse(html: str) -> Node:
    """The tree of a page; text is kept as decoded strings among the children."""
    root = Node("html")
    stack, at, n = [root], 0, len(html)
    open_tags: Counter[str] = Counter()  # of the stack, so that deep pages are not searched in vain

    def cut(k: int) -> None:
        open_tags.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def close(tags: set[str], until: set[str]) -> None:
        k = len(stack)
        while any(open_tags[t] > 0 for t in tags):
            k -= 1
            if stack[k].tag in until:
                return
            if stack[k].tag in tags:
                cut(k)

    while at < n:
        found = _TOKEN.search(html, at)
        text = html[at : found.start() if found else n]
        if text:
            text = unescape(text)
            if stack[-1].tag == "head" and text.strip(" \t\n\f\r"):
                cut(-1)
            stack[-1].children.append(text)
        if not found:
            break
        at = found.end()
        if name := found["end"]:
            name = name.lower()
            if name == "br":
                if stack[-1].tag == "head":
                    cut(-1)
                stack[-1].children.append(Node("br"))
            elif name == "p" and open_tags["p"] < 1:
                stack[-1].children.append(Node("p"))
            elif open_tags[name] > 0:
                whole = name in ("table", "html", "body")
                k = len(stack) - 1
                while stack[k].tag != name and (whole or stack[k].tag != "table"):
                    k -= 1
                if stack[k].tag == name:
                    cut(k)
        elif name := found["start"]:
            if not found["shut"]:
                break
            name = name.lower()
            if stack[-1].tag == "head" and name not in _HEAD:
                cut(-1)
            if name == "html" or (name == "body" and open_tags[name] > 0):
                continue
            if name in _IMPLIED:
                close(*_IMPLIED[name])
            elif name in _CLOSES_P:
                close({"p"}, {"table", "td", "th", "button", "object", "caption"})
            raw = found["attrs"]
            attrs = {a.lower(): (v[1:-1] if v[:1] in ("'", '"') else v) for a, v in _ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}
            style = attrs.get("style", "")
            hidden = "hidden" in attrs or (name == "input" and attrs.get("type") == "hidden") or (name == "dialog" and "open" not in attrs) or bool(_HIDING.search(style))
            said = _VISIBILITY.search(style)
            node = Node(name, hidden, said[1].lower() == "visible" if said else None, {k: v for k, v in attrs.items() if k in _KEPT})
            stack[-1].children.append(node)
            if name == "plaintext":
                node.children.append(html[at:])
                break
            if name in _RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                inside = html[at : end.start() if end else n]
                if name in ("textarea", "title", "xmp"):
                    node.children.append(inside if name == "xmp" else unescape(inside))
                at = end.end() if end else n
            elif name not in _VOID and not (raw.endswith("/") and name in ("svg", "math")):
                stack.append(node)
                open_tags[name] += 1
    return root


class _Page:
    """Lines under construction; breaks are asked for and written only before the next text."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks, self.space, self.indent, self.marker = 0, False, "", ""

    def gap(self, lines: int) -> None:
        self.breaks, self.space = max(self.breaks, lines), False

    def _open(self) -> None:
        if self.breaks and self.out:
            self.out.append("\n" * self.breaks)
        if self.breaks or not self.out:
            self.out.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker = ""
        self.breaks = 0

    def text(self, text: str) -> None:
        words = text.split()
        if not words:
            self.space = self.space or bool(text)
            return
        inside = bool(self.out) and not self.breaks
        self._open()
        if inside and (self.space or text[0].isspace()):
            self.out.append(" ")
        self.out.append(" ".join(words))
        self.space = text[-1].isspace()

    def lines(self, text: str) -> None:
        """Preformatted text."""
        for k, line in enumerate(text.split("\n")):
            if k:
                self.breaks += 1
            if line:
                self._open()
                self.out.append(line.replace("\r", ""))
                self.space = False


def _wrapped(cell: str) -> list[str]:
    """The lines of a cell, of at most ``_WIDE`` characters unless a word has more."""
    if len(cell) <= _WIDE:
        return [cell]
    lines, words, size = [], [], 0
    for word in cell.split(" "):
        if words and size + len(word) > _WIDE:
            lines.append(" ".join(words))
            words, size = [], 0
        words.append(word)
        size += len(word) + 1
    return [*lines, " ".join(words)]


Cell = tuple[list[str], int, int]  # lines, columns and rows that it spans


def _cell(node: Node, visible: bool) -> list[str]:
    """A cell's lines; those of preformatted text and lists stay as they are."""
    lines = [line for line in _rendered(node, visible).split("\n") if line.strip()]
    formatted = node.tag in ("pre", "textarea", "xmp") or _formatted(node)
    return lines if formatted else _wrapped(" ".join(" ".join(lines).split()))


def _formatted(node: Node) -> bool:
    waiting = [node]
    while waiting:
        for child in waiting.pop().children:
            if not isinstance(child, str):
                if child.tag in ("pre", "ul", "ol", "textarea", "xmp"):
                    return True
                waiting.append(child)
    return False


def _rows(node: Node, rows: list[list[Cell]], visible: bool) -> None:
    """The rows of a table; what stands outside of cells is a row of its own."""

    def alone(child: Node | str) -> None:
        text = " ".join((child if isinstance(child, str) else _rendered(child, visible)).split())
        if text and (visible or not isinstance(child, str)):
            rows.append([([text], 1, 1)])

    for child in node.children:
        if isinstance(child, str):
            alone(child)
            continue
        if child.hidden or child.tag in _UNSEEN:
            continue
        seen = visible if child.visible is None else child.visible
        if child.tag == "tr":
            row: list[Cell] = []
            outside = []
            for x in child.children:
                if not isinstance(x, str) and x.tag in ("td", "th"):
                    if not x.hidden:
                        row.append((_cell(x, seen if x.visible is None else x.visible), x.number("colspan", 1, 1, 1000), x.number("rowspan", 1, 1, 65534)))
                elif isinstance(x, str) or not x.hidden:
                    outside.append(x)
            rows.append(row)
            for x in outside:
                alone(x)
        elif child.tag in ("tbody", "thead", "tfoot"):
            _rows(child, rows, seen)
        else:
            alone(child)


def _laid(rows: list[list[Cell]]) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of (first column, columns, lines): cells move right of those that reach down from rows above."""
    out, taken = [], {}  # column: how many more rows it is taken
    for row in rows:
        column, placed, down = 0, [], {c: n - 1 for c, n in taken.items() if n > 1}
        for lines, wide, high in row:
            while taken.get(column, 0) > 0:
                column += 1
            placed.append((column, wide, lines))
            if high > 1:
                down |= dict.fromkeys(range(column, column + wide), high - 1)
            column += wide
        out.append(placed)
        taken = down
    return out


def _table(node: Node, page: _Page, visible: bool) -> None:
    rows: list[list[Cell]] = []
    _rows(node, rows, visible)
    laid = _laid(rows)
    width: dict[int, int] = {}
    aligned = [row for row in laid if len(row) > 1 or row and row[0][0] > 0]
    for row in aligned:
        for column, wide, lines in row:
            if wide == 1:
                width[column] = max(width.get(column, 0), *map(len, lines or [""]))
    for row in aligned:
        for column, wide, lines in row:
            known = sum(width.get(column + k, 0) + 2 for k in range(wide)) - 2
            if wide > 1 and (missing := max(map(len, lines or [""])) - known) > 0:
                width[column + wide - 1] = width.get(column + wide - 1, 0) + missing
    ends, begin = sorted(width), {}
    total = 0
    for c in range(ends[-1] + 2 if ends else 0):
        begin[c] = total
        total += width.get(c, 0) + 2
    for row in laid:
        shared = len(row) > 1 or row and row[0][0] > 0
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for column, _, lines in row:
                if k < len(lines):
                    line = line.ljust(begin.get(column, 0) if shared else 0) + lines[k]
            if line.strip():
                page.lines(line.rstrip())
                page.gap(1)


def _render(node: Node, page: _Page, pre: bool, visible: bool = True) -> None:
    items = sum(not isinstance(c, str) and c.tag == "li" for c in node.children) if "reversed" in node.attrs else 1
    count, step = node.number("start", items), -1 if "reversed" in node.attrs else 1
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if closed and (isinstance(child, str) or child.tag != "summary"):
            continue
        if isinstance(child, str):
            if visible:
                page.lines(child) if pre else page.text(child)
            continue
        tag = child.tag
        if child.hidden or tag in _UNSEEN:
            continue
        seen = visible if child.visible is None else child.visible
        if tag == "br":
            page.breaks, page.space = page.breaks + 1, False
            continue
        gap = 2 if tag in _SPACED and not (tag in ("ul", "ol", "dl") and page.indent) else 1 if tag in _BLOCKS else 0
        page.gap(gap) if gap else None
        if tag == "table":
            _table(child, page, seen)
        elif tag == "li":
            count = child.number("value", count) if node.tag == "ol" else count
            marker = f"{count}. " if node.tag == "ol" else "- "
            count += step
            before, page.indent, page.marker = page.indent, page.indent + " " * len(marker), marker
            _render(child, page, pre, seen)
            page.indent, page.marker = before, ""
        elif tag in ("blockquote", "dd"):
            before, page.indent = page.indent, page.indent + "  "
            _render(child, page, pre, seen)
            page.indent = before
        else:
            _render(child, page, pre or tag in ("pre", "textarea", "xmp", "plaintext"), seen)
        page.gap(gap) if gap else None


def _rendered(node: Node, visible: bool = True) -> str:
    page = _Page()
    _render(node, page, node.tag == "pre", visible)
    return "".join(page.out)


def visible_text(html: str | None) -> str:
    """All text of a page that a reader would see; empty for null. Elements may be nested as deep as the page is long."""
    if not html:
        return ""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 2 * html.count("<") + 1000))
    try:
        return _rendered(parse(html))
    finally:
        sys.setrecursionlimit(before)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add ``text`` to every row, replacing a column of that name, and drop ``html``; other columns pass through.

    A null or empty page has an empty text. Repeated rows each keep theirs.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [visible_text(h) for h in frame[html]]
            yield frame.drop(columns=[html]).assign(**{text: texts})

    kept = pages.drop(text)
    return kept.mapInPandas(batches, kept.drop(html).schema.add(text, "string"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.length("text").cast("long")).withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
