"""Visible text of HTML pages, laid out as a reader would see it.

A tree is built with the implied tags of HTML (open p, li, dt, dd, option, tr, td, th, thead and tbody end where the next
one or an enclosing block begins), then rendered: invisible parts go, blocks begin on new lines, paragraphs, headings,
lists and tables stand between blank lines, list items carry their mark and indent, pre keeps its white space, and table
cells are padded to the width of their column and parted by " | ".

Invisible: head, script, style, template, noscript and embedded media; elements with the hidden attribute, with
display:none or visibility:hidden in their style, or of input type hidden; a closed dialog, and all but the summary of
closed details. All other text appears.

Defined results: null, empty or text-free pages give "". Broken or cut-off markup is read as far as it goes: an
unfinished tag at the end is dropped. Elements nested deeper than 400 levels are hung at level 400, as browsers cap depth
too; their text stays. Repeated rows are rendered each for itself; null ids and urls stay null; other columns that the
page table has are dropped.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 400
# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = set("head script style template noscript iframe object canvas audio video svg datalist area base link meta param source track col colgroup embed img title".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table ul".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure hr fieldset".split())
LISTS = set("ul ol menu dir".split())
ENDS_P = BLOCK - {"option", "optgroup", "select", "legend", "html", "body"}
CLOSES = {  # a starting tag ends these open elements, looking up to the barriers
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "tr": ({"td", "th", "tr"}, {"table"}), "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}), "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
HEAD_ONLY = set("head title meta link base style script template noscript".split())
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
UNFINISHED = re.compile(r"<[A-Za-z/!?]")
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Tree of a page, with implied ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.stack = [self.root]

    def end_implied(self, ends: set[str], barriers: set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in barriers:
                return
            if tag in ends:
                del self.stack[i:]
                return self.end_implied(ends, barriers)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag not in HEAD_ONLY and any(x.tag == "head" for x in self.stack[1:2]):
            del self.stack[1:]
        if tag in ENDS_P:
            self.end_implied({"p"}, {"td", "th", "table", "button", "object"})
        if tag in CLOSES:
            self.end_implied(*CLOSES[tag])
        node = Node(tag, dict(attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID and len(self.stack) < MAX_DEPTH:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if self.stack[i].tag == "table" and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if len(self.stack) > 1 and self.stack[-1].tag == "head" and data.strip():
            self.stack.pop()
        self.stack[-1].children.append(data)


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in INVISIBLE or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return False
    return not (a.get("style") and HIDING.search(a["style"])) and not (node.tag == "input" and (a.get("type") or "").lower() == "hidden")


class Lines:
    """Lines of text with collapsed white space; gap counts the line ends owed before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now, self.gap, self.marks, self.blank = "", 0, [], False

    def end_line(self, gap: int = 1) -> None:
        if self.now.strip(" "):
            self.lines.append(self.now.rstrip(" "))
            self.now = ""
            self.gap = gap
        else:
            self.now = ""
            self.gap = max(self.gap, gap) if self.lines else 0
        self.blank = False

    def begin(self) -> None:
        if not self.now:
            self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
            self.now = "".join(self.marks)
            self.marks = [" " * len(m) for m in self.marks]
            self.blank = True

    def text(self, data: str) -> None:
        data = BLANKS.sub(" ", data)
        if data.startswith(" ") and (self.blank or not self.now or self.now.endswith(" ")):
            data = data[1:]
        if data:
            self.begin()
            self.now += data
            self.blank = False

    def kept(self, data: str) -> None:
        """Text of pre, with its own lines and blanks."""
        for i, line in enumerate(data.replace("\r\n", "\n").split("\n")):
            if i:
                self.begin()
                self.lines.append(self.now.rstrip(" "))
                self.now, self.gap, self.blank = "", 0, False
            if line:
                self.begin()
                self.now += line.expandtabs(8)
                self.blank = False

    def line_break(self) -> None:
        if self.now.strip(" "):
            self.end_line(1)
        elif self.lines:
            self.gap = max(self.gap, 1) + 1

    def whole(self, lines: list[str]) -> None:
        for line in lines:
            self.begin()
            self.now = (self.now + line) or " "
            self.lines.append(self.now.rstrip(" "))
            self.now = ""
        self.gap, self.blank = 1, False

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _number(text: str | None, default: int, most: int = 10**6) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return min(int(m[1]), most) if m else default


def table_rows(node: Node) -> list[list[Node]]:
    rows: list[list[Node]] = []
    for child in node.children:
        if isinstance(child, str) or not visible(child):
            continue
        if child.tag == "tr":
            rows.append([c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)])
        elif child.tag in ("tbody", "thead", "tfoot"):
            rows.extend(table_rows(child))
        elif child.tag in ("td", "th"):
            rows.append([child])
    return rows


def strays(node: Node) -> list[Node | str]:
    """Visible content in a table that belongs to no cell; it is shown before the table, as browsers do."""
    out: list[Node | str] = []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                out.append(child)
        elif child.tag in ("tr", "tbody", "thead", "tfoot"):
            if visible(child):
                out.extend(strays(child))
        elif child.tag not in ("td", "th"):
            out.append(child)
    return out


def render_table(node: Node, out: Lines) -> None:
    for child in strays(node):
        render(child, out, False)
        out.end_line()
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell above still covers
    for row in table_rows(node):
        cells, column, now = {}, 0, dict(taken)
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row:
            while now.get(column, 0):
                column += 1
            inner = Lines()
            for child in cell.children:
                render(child, inner, False)
            cells[column] = inner.done()
            wide = max(1, _number(cell.attrs.get("colspan"), 1, 1000))
            tall = _number(cell.attrs.get("rowspan"), 1, 65534)
            for c in range(column, column + wide):
                if tall > 1:
                    taken[c] = tall - 1
            column += wide
        grid.append(cells)
    columns = sorted({c for cells in grid for c, lines in cells.items() if any(lines)})
    width = {c: max(len(line) for cells in grid for line in cells.get(c, [""]) or [""]) for c in columns}
    lines = []
    for cells in grid:
        for i in range(max((len(x) for x in cells.values()), default=0)):
            lines.append(" | ".join((cells[c][i] if i < len(cells.get(c, [])) else "").ljust(width[c]) for c in columns).rstrip(" "))
    if lines:
        out.whole(lines)


def render(node: Node | str, out: Lines, pre: bool) -> None:
    if isinstance(node, str):
        return out.kept(node) if pre else out.text(node)
    if not visible(node):
        return None
    tag = node.tag
    if tag == "br":
        return out.line_break()
    if tag == "wbr":
        return None
    if tag == "input":
        if (node.attrs.get("type") or "text").lower() not in ("checkbox", "radio", "image", "file", "password") and node.attrs.get("value"):
            out.text(node.attrs["value"])
        return None
    gap = 2 if tag in SPACED else 1
    if tag in LISTS and out.marks:
        gap = 1  # a list in a list stands close
    if tag in BLOCK:
        out.end_line(gap)
    if tag == "table":
        render_table(node, out)
    elif tag in LISTS:
        number = _number(node.attrs.get("start"), 1)
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li" and visible(child):
                number = _number(child.attrs.get("value"), number)
                mark = f"{number}. " if tag == "ol" else "- "
                number += 1
                depth = len(out.marks)
                out.end_line(1)
                out.marks.append(mark)
                for inner in child.children:
                    render(inner, out, pre)
                out.end_line(1)
                del out.marks[depth:]
            else:
                render(child, out, pre)
    else:
        inner = node.children
        if tag == "details" and "open" not in node.attrs:
            inner = [c for c in inner if isinstance(c, Node) and c.tag == "summary"][:1]
        depth = len(out.marks)
        if tag in ("blockquote", "dd"):
            out.marks.append("  ")
        for child in inner:
            render(child, out, pre or tag in ("pre", "textarea", "listing"))
        if tag in BLOCK:
            out.end_line(gap)
        del out.marks[depth:]
        return None
    out.end_line(gap)
    return None


def page_text(html: str | None) -> str:
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    if UNFINISHED.match(builder.rawdata):
        builder.rawdata = ""
    builder.close()
    out = Lines()
    render(builder.root, out, False)
    return "\n".join(out.done()).strip("\n")


def render_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page; map-side, no shuffle."""

    def run(batches):
        import sys

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                texts = [page_text(x) for x in some.column(2).to_pylist()]
                arrays = [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    some = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return some.mapInArrow(run, "page_id long, url string, text string, n_chars long")
