"""Layout-aware text of HTML pages.

A tree builder reads tags as browsers do where it matters for text: void elements, implied end tags (paragraphs before
blocks, list items, table parts, options), raw text elements, and end tags that close what is open inside them. Elements that
are never shown (scripts, styles, templates, the head) or are hidden by attribute or inline style are left out with all
they contain. The rest is rendered: white space collapses outside ``pre``, paragraphs and headings stand apart by a blank line, other
blocks begin a line, list items get their marker and indentation, and table cells are padded so that columns align
(column and row spans included). All visible text is emitted, none twice.

Null or empty HTML gives an empty text; text without tags is its own paragraph; tags cut off by the end are dropped. A quoted
value begins after ``=`` only; a quote elsewhere, or one that nothing closes, does not keep a tag from ending at its first ``>``. Elements
nested deeper than ``DEPTH`` are kept as siblings, without the layout of tables and ``pre``; what they hide stays hidden, and their
end tags close them and nothing around them. Every row gives a row, with a null or repeated id too; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from .textvec import slices

DEPTH = 200
SCHEMA = "page_id long, title string, n_chars long, n_lines long, text_sha256 string, text string"

# Element names by the part they play.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script": False, "style": False, "xmp": False, "iframe": False, "noembed": False, "noframes": False, "title": True, "textarea": True}
UNSHOWN = set("head script style template noscript iframe noembed noframes title datalist object svg math audio video canvas".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCKS = SPACED | set(
    "address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav "
    "search section summary tr td th caption thead tbody tfoot option optgroup".split())
CLOSES_P = BLOCKS - set("td th tr thead tbody tfoot caption body html li dd dt option optgroup".split()) | {"li", "dd", "dt"}
TABLE_PARTS = set("table thead tbody tfoot tr td th caption".split())
HEAD_PARTS = set("base link meta title style script template noscript".split())
#: Opening one of the keys ends an open element of the values, if none of the barriers is open inside it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    **{t: ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
    "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}

_VALUE = r"[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"{0}\"|'{1}'|{2})"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:"
    + _VALUE.format('[^"]*+', "[^']*+", r"[^ \t\n\r\f>]*+") + r")?+)*+)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:" + _VALUE.format('([^"]*+)', "([^']*+)", r"([^ \t\n\r\f>]*+)") + ")?+")
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
BLANK = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.children = tag, []
        self.attributes = {}
        if attributes.strip(" \t\r\n\f/"):
            for m in ATTRIBUTE.finditer(attributes):
                self.attributes.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))

    def hidden(self) -> bool:
        return self.tag in UNSHOWN or "hidden" in self.attributes or HIDING.search(self.attributes.get("style", "")) is not None

    def number(self, name: str, least: int, most: int = 1000) -> int:
        value = self.attributes.get(name, "")
        return min(most, max(least, int(value))) if value.lstrip("-").isdecimal() and value.isascii() and len(value) < 10 else least


class Beyond:
    """Open elements past the depth of the tree: their names, the places of each name, and the first that hides what it holds."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.hidden: int | None = None

    def push(self, element: Element) -> None:
        if self.hidden is None and element.hidden():
            self.hidden = len(self.tags)
        self.places[element.tag].append(len(self.tags))
        self.tags.append(element.tag)

    def last(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def first(self, tags: set[str], after: int) -> int | None:
        found = (p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, after)) < len(p))
        return min(found, default=None)

    def cut(self, at: int) -> bool:
        """Ends the elements from a place on; whether a block is among them."""
        block = False
        while len(self.tags) > at:
            tag = self.tags.pop()
            self.places[tag].pop()
            block |= tag in BLOCKS
        if self.hidden is not None and self.hidden >= at:
            self.hidden = None
        return block


class Builder:
    """Builds the tree of one page; ``root`` holds everything, ``title`` the first title."""

    def __init__(self, html: str) -> None:
        self.root, self.title = Element("html"), None
        self.open, self.beyond = [self.root], Beyond()
        at = 0
        while m := TAG.search(html, at):
            self.text(html[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.end(tag)
                elif m[4]:
                    at = self.start(tag, m[3], html, at)
        rest = html[at:]
        self.text(rest)

    def text(self, text: str) -> None:
        if text and self.beyond.hidden is None:
            if self.open[-1].tag == "head" and not text.isspace():
                self.open.pop()
            self.open[-1].children.append(unescape(text) if "&" in text else text)

    def _add(self, element: Element) -> None:
        if self.beyond.hidden is None:
            self.open[-1].children.append(element)

    def _cut_beyond(self, at: int) -> None:
        """Ends elements past the depth; after a block a line ends."""
        if self.beyond.cut(at):
            self._add(Element("div"))

    def _cut(self, at: int) -> None:
        self.beyond.cut(0)
        del self.open[at:]

    def _close(self, tags: set[str], barriers: set[str]) -> None:
        """Ends the outermost open element of ``tags`` above the last barrier."""
        barrier = self.beyond.last(barriers)
        inner, found = self.beyond.first(tags, barrier), None
        for k in range(len(self.open) - 1, 0, -1) if barrier < 0 else ():
            if self.open[k].tag in tags:
                found = k
            elif self.open[k].tag in barriers:
                break
        if found is not None:
            self._cut(found)
        elif inner is not None:
            self._cut_beyond(inner)

    def start(self, tag: str, attributes: str, html: str, at: int) -> int:
        if tag == "html" or tag == "body" and any(e.tag == "body" for e in self.open):
            return at
        if self.open[-1].tag == "head" and tag not in HEAD_PARTS:
            self.open.pop()
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in CLOSES_P:
            self._close({"p"}, TABLE_PARTS | {"button", "object"})
        element = Element(tag, attributes)
        self._add(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            body = html[at : end.start() if end else len(html)]
            element.children.append(unescape(body) if RAW[tag] else body)
            if tag == "title" and self.title is None:
                self.title = BLANK.sub(" ", element.children[0]).strip()
            if end is None:
                return len(html)
            close = html.find(">", end.end())
            return len(html) if close < 0 else close + 1
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            if len(self.open) < DEPTH:
                self.open.append(element)
            else:
                self.beyond.push(element)
        return at

    def end(self, tag: str) -> None:
        if tag == "br":
            self._add(Element("br"))
        elif tag == "p" and self.beyond.last({"p"}) < 0 and not any(e.tag == "p" for e in self.open):
            self._add(Element("p"))
        elif tag not in ("html", "body"):
            barriers = {"table"} if tag in TABLE_PARTS - {"table"} else set() if tag in TABLE_PARTS else {"td", "th", "caption", "table"}
            own, barrier = self.beyond.last({tag}), self.beyond.last(barriers)
            if own >= 0 and own >= barrier:
                self._cut_beyond(own)
            if max(own, barrier) >= 0:
                return
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    self._cut(k)
                    return
                if self.open[k].tag in barriers:
                    return


class Writer:
    """Lines of text with collapsed white space, blank lines where blocks stand apart, and indentation."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        #: For each level what stands before its next line and before those that follow.
        self.indents: list[list[str]] = []
        self.space = self.gap = False

    def text(self, text: str) -> None:
        if any(c in text for c in ("  ", "\n", "\t", "\r", "\f")):
            text = BLANK.sub(" ", text)
        self.space |= text.startswith(" ")
        words = text.strip(" ")
        if words:
            if self.line and self.space:
                self.line.append(" ")
            self.line.append(words)
            self.space = text.endswith(" ")

    def preformatted(self, text: str) -> None:
        first, *others = text.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for line in others:
            self.end_line(True)
            self.line.append(line)

    def end_line(self, even_empty: bool = False) -> None:
        text = "".join(self.line)
        if text or even_empty:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(("".join(i[0] for i in self.indents) + text).rstrip())
            for indent in self.indents:
                indent[0] = indent[1]
        self.line, self.space = [], False

    def block(self, apart: bool) -> None:
        self.end_line()
        self.gap |= apart

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def render(element: Element, out: Writer, pre: bool = False) -> None:
    """Writes what is visible of an element."""
    number = element.number("start", 1, 10**9)
    for child in element.children:
        if isinstance(child, str):
            (out.preformatted if pre else out.text)(child)
            continue
        tag = child.tag
        if tag == "br":
            out.end_line(True)
            continue
        if child.hidden():
            continue
        # A list inside a list item follows its text without a blank line.
        apart = tag in SPACED and not (tag in ("ul", "ol") and out.indents)
        if tag in BLOCKS:
            out.block(apart)
        if tag == "li":
            marker = f"{number}. " if element.tag == "ol" else "- "
            number += element.tag == "ol"
            out.indents.append([marker, " " * len(marker)])
        elif tag in ("blockquote", "dd"):
            out.indents.append(["  ", "  "])
        if tag == "table":
            _render_table(child, out)
        else:
            render(child, out, pre or tag in ("pre", "textarea"))
        if tag in BLOCKS:
            out.block(apart)
        if tag in ("li", "blockquote", "dd"):
            out.indents.pop()


def _table_rows(table: Element) -> tuple[list[list[Element]], list]:
    """Rows of cells, and what else the table holds in its order."""
    rows, others = [], []

    def visit(element: Element, row: list | None) -> None:
        for child in element.children:
            if isinstance(child, str):
                if not child.isspace():
                    others.append(child)
            elif child.hidden():
                continue
            elif child.tag in ("thead", "tbody", "tfoot"):
                visit(child, None)
            elif child.tag == "tr":
                rows.append([])
                visit(child, rows[-1])
            elif child.tag in ("td", "th"):
                if row is None:
                    rows.append(row := [])
                row.append(child)
            else:
                others.append(child)

    visit(table, None)
    return rows, others


def _render_table(table: Element, out: Writer) -> None:
    rows, others = _table_rows(table)
    if others:
        aside = Element("div")
        aside.children = others
        render(aside, out)
        out.end_line()
    grid: list[dict[int, tuple[str, int]]] = []
    busy: dict[int, int] = {}
    for row in rows:
        texts, spans, at = {}, {}, 0
        for cell in row:
            while busy.get(at):
                at += 1
            inner = Writer()
            render(cell, inner)
            wide, down = cell.number("colspan", 1), cell.number("rowspan", 1, 65_534)
            texts[at] = (BLANK.sub(" ", inner.result()).strip(), wide)
            spans |= {c: down for c in range(at, at + wide)}
            at += wide
        grid.append(texts)
        busy = {c: n - 1 for c, n in (busy | spans).items() if n > 1}
    widths: dict[int, int] = {}
    for texts in grid:
        for at, (text, wide) in texts.items():
            if wide == 1:
                widths[at] = max(widths.get(at, 0), len(text))
    for texts in grid:  # a cell over several columns widens the last of them
        for at, (text, wide) in texts.items():
            if wide > 1:
                room = sum(widths.setdefault(c, 0) for c in range(at, at + wide)) + 2 * (wide - 1)
                widths[at + wide - 1] += max(0, len(text) - room)
    starts, place = {}, 0
    for c in sorted(widths):
        starts[c] = place
        place += widths[c] + 2
    for texts in grid:
        line = ""
        for at, (text, _) in sorted(texts.items()):
            if text:
                line = line.ljust(starts[at]) + text
        if line:
            out.line.append(line)
            out.end_line()


def page_text(html: str) -> tuple[str | None, str]:
    """Title and visible text."""
    page = Builder(html)
    out = Writer()
    render(page.root, out)
    return page.title, out.result()


def _page_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, htmls in slices(batches, "html"):
        found = [page_text(h) for h in htmls.to_pylist()]
        texts = [t for _, t in found]
        yield pa.record_batch(
            [rows.column("page_id"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.string())],
            ["page_id", "title", "n_chars", "n_lines", "text_sha256", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """Title and visible text of every row of ``pages`` (``page_id``, ``html``)."""
    return pages.select("page_id", "html").mapInArrow(_page_task, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return extracted(configure(spark).read.parquet(f"{sf_dir}/pages.parquet"))
