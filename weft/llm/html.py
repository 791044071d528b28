"""Layout-aware text of HTML pages.

A tokeniser splits markup from text; a tree builder opens and closes elements by HTML's rules for omitted tags (a
block closes a paragraph, an item its predecessor, a cell the cell before it, and so on); visibility rules drop what a browser
would not show; a renderer then walks the tree and emits all visible text with the layout's line structure: blank
lines around paragraphs, headings, lists and tables, one line per block, bullets and numbers with indents, preformatted
text as it stands, and tables with their cells aligned in columns. A cell keeps the lines of its content, so paragraphs, lists and
tables inside it stay what they are; a row is as high as its highest cell. The walk keeps its own stack, so nesting of any
depth is fine. Every step is linear in the page apart from nested tables, whose lines are laid out once per level: columns that a
span passes over cost nothing, and a line wider than WIDE runs over its column instead of padding all others.

Of a drop-down list the chosen option shows, else the first; of a list box all. Text in drawings and formulas shows.

Defined cases: null or empty markup gives an empty text; unclosed tags and comments run to the end of the page; stray end tags
are ignored. Repeated rows give repeated results and an empty table an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from itertools import accumulate
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.text import utf8

MARKUP = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template title noscript iframe noembed noframes datalist object audio video canvas "
    "defs desc metadata symbol clippath marker annotation annotation-xml".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu hr xmp".split())
CLOSES_P = BLOCKS - frozenset("html body caption dd dt li td th tr tbody thead tfoot legend".split()) | frozenset(["li", "dd", "dt"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("tbody thead tfoot".split())
CELLS = frozenset("td th".split())
LISTS = frozenset("ul ol menu dir".split())
#: What an opening tag closes if open, and the elements beyond which nothing is closed.
CLOSES = {
    "li": (frozenset(["li"]), LISTS | CELLS | {"table"}),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"]) | CELLS),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"]) | CELLS),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "td": (CELLS, frozenset(["table"])),
    "th": (CELLS, frozenset(["table"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (SECTIONS | {"caption", "colgroup"}, frozenset(["table"])),
    "thead": (SECTIONS | {"caption", "colgroup"}, frozenset(["table"])),
    "tfoot": (SECTIONS | {"caption", "colgroup"}, frozenset(["table"])),
}
#: Shown apart from the text around them, in the same line.
APART = frozenset("select button text".split())
#: Widest line, in columns, that the other cells of its column are padded to.
WIDE = 160
P_BARRIER = CELLS | frozenset("table caption button object".split())


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []

    def attribute(self, wanted: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == wanted:
                return html.unescape((m[2] or "").strip("\"'"))
        return None

    def visible(self) -> bool:
        if self.name in HIDDEN:
            return False
        low = self.attributes.lower()
        if "hidden" in low and self.attribute("hidden") is not None:
            return False
        return not ("style" in low and HIDING.search(self.attribute("style") or ""))


class Builder:
    """Tree of nodes and strings."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.count: dict[str, int] = {}

    def _pop(self, to: int) -> None:
        for node in self.open[to:]:
            self.count[node.name] -= 1
        del self.open[to:]

    def _close(self, names: frozenset[str], barrier: frozenset[str]) -> None:
        if not any(self.count.get(name) for name in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in names:
                self._pop(k)
                return
            if self.open[k].name in barrier:
                return

    def _push(self, name: str, attributes: str = "") -> Node:
        node = Node(name, attributes)
        self.open[-1].children.append(node)
        self.open.append(node)
        self.count[name] = self.count.get(name, 0) + 1
        return node

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and self.count.get(name):
            return
        if self.count.get("head") and (name == "body" or name in BLOCKS and name != "html"):
            self._close(frozenset(["head"]), frozenset())
        if name in CLOSES_P:
            self._close(frozenset(["p"]), P_BARRIER)
        if name in HEADINGS and self.open[-1].name in HEADINGS:
            self._pop(len(self.open) - 1)
        if name in CLOSES:
            self._close(*CLOSES[name])
        here = self.open[-1].name
        if name in CELLS and here in SECTIONS | {"table"}:
            self._push("tr")
        self._push(name, attributes)
        if name in VOID or self.closed(attributes):
            self._pop(len(self.open) - 1)

    def closed(self, attributes: str) -> bool:
        """Whether a tag with these attributes closes itself, as tags of drawings and formulas may."""
        return attributes.endswith("/") and bool(self.count.get("svg") or self.count.get("math"))

    def end(self, name: str) -> None:
        if name == "br":
            return self.start("br", "")
        if name in VOID or not self.count.get(name) or name in ("html", "body"):
            return
        barrier = frozenset() if name in CELLS | SECTIONS | {"table", "tr"} else frozenset(["table"]) | CELLS
        self._close(frozenset([name]), barrier)

    def text(self, text: str) -> None:
        if text:
            self.open[-1].children.append(text)


def parse(markup: str) -> Node:
    builder, at = Builder(), 0
    while at < len(markup):
        found = MARKUP.search(markup, at)
        if found is None:
            builder.text(html.unescape(markup[at:]))
            break
        if found.start() > at:
            builder.text(html.unescape(markup[at : found.start()]))
        at = found.end()
        if found["close"]:
            builder.end(found["close"].lower())
        elif found["open"]:
            name, attributes = found["open"].lower(), found["attributes"] or ""
            whole = builder.closed(attributes)
            builder.start(name, attributes)
            if name in RAW and not whole:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(markup, at)
                content = markup[at : stop.start() if stop else len(markup)]
                builder.text(html.unescape(content) if name in ("textarea", "title") else content)
                if stop:
                    at = markup.find(">", stop.start()) + 1 or len(markup)
                else:
                    at = len(markup)
                builder.end(name)
    return builder.root


def width(text: str) -> int:
    """Columns a text takes: wide characters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Buffer:
    """Lines of one flow of content."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = False  # a blank line is due before the next text
        self.prefix = ""  # of the next line
        self.indent = ""
        self.space = False

    def inline(self, text: str) -> None:
        squeezed = SPACE.sub(" ", text)
        if not squeezed:
            return
        if squeezed[0] == " ":
            self.space = True
            squeezed = squeezed[1:]
        if not squeezed:
            return
        trailing = squeezed[-1] == " "
        self._put(squeezed.rstrip(" "))
        self.space = trailing

    def _put(self, text: str) -> None:
        if not self.parts:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.parts.append(self.prefix or self.indent)
            self.prefix = ""
        elif self.space:
            self.parts.append(" ")
        self.space = False
        self.parts.append(text)

    def line(self) -> None:
        """End the line, if it has any text."""
        if self.parts:
            self.lines.append("".join(self.parts))
            self.parts = []
        self.space = False

    def hard_break(self) -> None:
        if self.parts:
            self.line()
        elif self.lines and not self.blank:
            self.lines.append("")

    def whole(self, lines: list[str]) -> None:
        """Lines as they stand."""
        self.line()
        for k, text in enumerate(lines):
            if k == 0:
                self._put(text)
            else:
                self.parts = [self.indent, text]
            self.lines.append("".join(self.parts))
            self.parts = []

    def preformatted(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        if first:
            self._put(first)
        for text in rest:
            self.lines.append("".join(self.parts))
            self.parts = [self.indent + text] if text else []
        self.space = False

    def result(self) -> list[str]:
        self.line()
        return self.lines


class Renderer:
    def __init__(self) -> None:
        self.buffers = [Buffer()]
        self.tables: list[list[list[tuple[list[str], int]]]] = []
        self.lists: list[list] = []  # [ordered, next number]
        self.pre = 0
        self.undo: list[tuple] = []

    def text(self, text: str) -> None:
        if self.pre:
            self.buffers[-1].preformatted(text)
        else:
            self.buffers[-1].inline(text)

    def enter(self, node: Node) -> None:
        name, out = node.name, self.buffers[-1]
        if name == "br":
            return out.hard_break()
        if name in APART:
            out.space = True
        if name == "select":
            choose(node)
        if name in ("td", "th") and self.tables:
            self.buffers.append(Buffer())
            self.undo.append((self.lists, self.pre))
            self.lists, self.pre = [], 0
            return
        if name == "tr" and self.tables:
            self.tables[-1].append([])
            return
        if name in BLOCKS:
            out.line()
            if name in SPACED and not (name in LISTS and self.lists):
                out.blank = True
        if name == "hr":
            out.whole(["---"])
            out.blank = True
        elif name in LISTS:
            start = node.attribute("start") if name == "ol" else None
            self.lists.append([name == "ol", int(start) if start and start.lstrip("-").isdecimal() and len(start) < 10 else 1, out.indent])
        elif name == "li":
            base = out.indent
            if self.lists and self.lists[-1][0]:
                mark = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            else:
                mark = "- "
            self.undo.append((base,))
            out.prefix, out.indent = base + mark, base + " " * len(mark)
        elif name in ("blockquote", "dd"):
            self.undo.append((out.indent,))
            out.indent += "  "
        elif name in ("pre", "xmp"):
            self.pre += 1
        elif name == "table":
            self.tables.append([])

    def leave(self, node: Node) -> None:
        name = node.name
        if name in ("td", "th") and self.tables:
            cell = [line.rstrip() for line in self.buffers.pop().result()]
            self.lists, self.pre = self.undo.pop()
            while cell and not cell[-1]:
                cell.pop()
            span = node.attribute("colspan") if node.attributes else None
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append((cell, min(1000, int(span)) if span and span.isdecimal() and len(span) < 6 and int(span) else 1))
            return
        out = self.buffers[-1]
        if name in APART:
            out.space = True
        elif name == "table":
            out.whole(aligned(self.tables.pop()))
        elif name == "li":
            out.line()
            (out.indent,) = self.undo.pop()
            out.prefix = ""
        elif name in ("blockquote", "dd"):
            out.line()
            (out.indent,) = self.undo.pop()
        elif name in LISTS:
            out.line()
            out.indent = self.lists.pop()[2]
        elif name in ("pre", "xmp"):
            self.pre -= 1
        if name in BLOCKS and name != "tr":
            out.line()
            if name in SPACED and not (name in LISTS and self.lists):
                out.blank = True


def choose(select: Node) -> None:
    """Hide the options that a drop-down list does not show, and put those of a list box on lines of their own."""
    options, work = [], list(reversed(select.children))
    while work:
        node = work.pop()
        if isinstance(node, Node):
            if node.name == "option":
                options.append(node)
            else:
                work.extend(reversed(node.children))
    size = select.attribute("size") or ""
    if select.attribute("multiple") is not None or size.isdecimal() and len(size) < 6 and int(size) > 1:
        for node in options:
            node.name = "div"
        return
    chosen = next((node for node in reversed(options) if node.attribute("selected") is not None), options[0] if options else None)
    for node in options:
        if node is not chosen:
            node.attributes += " hidden"


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Lines of rows of cells (lines, span), every column padded to its widest line; a cell over several columns does not widen them."""
    rows = [row for row in rows if any(lines for lines, _ in row)]
    if all(len(row) == 1 for row in rows):
        return [line for row in rows for line in row[0][0]]
    wide: dict[int, int] = {}  # of the columns that some cell starts in
    for row in rows:
        column = 0
        for lines, span in row:
            room = max((width(line) for line in lines), default=0) if span == 1 else 0
            wide[column] = max(wide.get(column, 0), room if room <= WIDE else 0)
            column += span
    columns = sorted(wide)
    ends = list(accumulate((wide[c] + 2 for c in columns), initial=0))  # where each of columns begins
    out = []
    for row in rows:
        column, places = 0, []
        for lines, span in row:
            places.append((lines, ends[bisect_left(columns, column)]))
            column += span
        for k in range(max(len(lines) for lines, _ in row)):
            line, used = [], 0
            for lines, at in places:
                if k < len(lines) and lines[k]:
                    gap = max(at - used, 2 if used else 0)
                    line.append(" " * gap + lines[k])
                    used += gap + width(lines[k])
            out.append("".join(line))
    return out


def extract(markup: str) -> str:
    """All visible text of a page, laid out."""
    renderer = Renderer()
    stack: list[tuple[Node, int]] = [(parse(markup), 0)]
    while stack:
        node, k = stack.pop()
        if k == 0:
            renderer.enter(node)
        if k < len(node.children):
            stack.append((node, k + 1))
            child = node.children[k]
            if isinstance(child, str):
                renderer.text(child)
            elif child.visible():
                stack.append((child, 0))
        else:
            renderer.leave(node)
    lines = [line.replace("\xa0", " ").rstrip() for line in renderer.buffers[0].result()]
    return "\n".join(lines).strip("\n")


def extract_column(markup: str | Column = "html") -> Column:
    @F.arrow_udf("string")
    def visible_text(values: pa.Array) -> pa.Array:
        return pa.array([extract(x.as_py().decode("utf-8", "replace")) for x in values], pa.string())

    return visible_text(utf8(markup))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: id, text, n_chars, n_lines."""
    out = pages.select(F.col(id_col), extract_column(html_col).alias("text"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return out.select(id_col, "text", F.char_length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
