"""Operator 8: visible text of HTML pages, laid out.

A tree builder with implied tags reads the page, visibility rules drop what a browser would not show, and the layout keeps block
spacing, list markers and aligned table cells. Pages are independent: Spark deals them out, one small parser works on each, in
time proportional to its page. Padding is bounded: a line is indented by at most `WIDEST_LEAD` blanks, a column is padded to at
most `WIDEST_COLUMN` and begins within `WIDEST_LINE`; what is longer stays whole and pushes the rest of its line on.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionlens.llm.common import pieces, tuned

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
NEVER_SHOWN = frozenset("head script style title template noscript iframe noembed noframes datalist rp area base link meta param audio video canvas object".split())
#: Not shown within drawings and formulas; what is drawn by reference only; and elements whose parts stand apart.
FOREIGN = frozenset("svg math".split())
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker filter lineargradient radialgradient annotation annotation-xml".split())
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mtr".split())
#: Starting one of these ends an open drawing or formula.
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Most columns of a cell in the standard.
WIDEST_SPAN = 1000
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
#: Block elements; those in SPACED stand between blank lines.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table ul xmp".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul dir xmp".split())
LISTS = frozenset("ul ol menu dir".split())
#: Starting one of these ends an open paragraph.
ENDS_P = (BLOCK | {"table"}) - frozenset("body html option optgroup legend".split())
#: Starting the key ends the innermost open element of the values, unless one of the bounds is met first.
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
#: An end tag does not reach beyond these.
SCOPE = frozenset("table td th caption html template".split())
KEEPS_P = SCOPE | {"button"}
INDENT = 2
#: Tables within so many tables are laid out as blocks.
DEEPEST = 20
#: Bounds of padding, in characters: indentation, a column of a table, where a table's last aligned column begins.
WIDEST_LEAD, WIDEST_COLUMN, WIDEST_LINE = 60, 80, 400

_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_EMPTY = re.compile(r"""(?:^|[\s"']|(?:^|\s)[^\s=/"'>]+)/$""")  # a tag that ends itself; the slash of an unquoted value is its own
_SPACE = re.compile(r"[ \t\n\r\f]+")

OUT = "page_id long, text string, n_chars long, n_lines long"


class Node:
    __slots__ = ("tag", "attributes", "children", "foreign")

    def __init__(self, tag: str, attributes: str = "", foreign: bool = False):
        self.tag, self.attributes, self.children, self.foreign = tag, attributes, [], foreign

    def get(self) -> dict[str, str]:
        found: dict[str, str] = {}
        if self.attributes:
            for name, value in _ATTRIBUTE.findall(self.attributes):
                found.setdefault(name.lower(), unescape(value.strip("\"'")))
        return found


class Stack:
    """The open elements; the innermost one of some tags is known without a search."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {root.tag: [0]}

    def __getitem__(self, k: int) -> Node:
        return self.nodes[k]

    def __len__(self) -> int:
        return len(self.nodes)

    def append(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        self.places[self.nodes.pop().tag].pop()

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            self.pop()

    def innermost(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 for none: the root is never ended."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(page: str) -> Node:
    """The tree of a page; broken markup gives a tree too, and what is left open ends with the page."""
    root = Node("html")
    stack = Stack(root)
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip():
                stack.pop()
            stack[-1].children.append(unescape(s) if "&" in s else s)

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            text(page[at:])
            break
        after = page[lt + 1]
        if after == "!" or after == "?":
            text(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = after == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:  # a bare < is text
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        rest = _ATTRIBUTES.match(page, name.end())
        end = rest.end() if rest else page.find(">", name.end()) + 1
        if not end:
            break  # the page ends within a tag
        tag = name.group().lower()
        attributes = page[name.end() : end - 1]
        at = end
        if closing:
            _close(stack, tag)
            continue
        _open(stack, tag, attributes)
        if tag in RAW and stack[-1].tag == tag:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
            inside = page[at : found.start()] if found else page[at:]
            stack[-1].children.append(unescape(inside) if tag in ("textarea", "title") else inside)
            stack.pop()
            at = found.end() if found else n
    return root


def _close(stack: Stack, tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br"))
        return
    limits = () if tag in SCOPE else ("table",) if tag in ("tr", "thead", "tbody", "tfoot", "body") else SCOPE
    k = stack.innermost((tag,))
    if k > stack.innermost(limits):
        stack.cut(k)


def _open(stack: Stack, tag: str, attributes: str) -> None:
    inner = stack[-1]
    if inner.foreign and inner.tag not in ("foreignobject", "annotation-xml"):
        if tag not in ENDS_FOREIGN:
            node = Node(tag, attributes, True)
            inner.children.append(node)
            if not _EMPTY.search(attributes):
                stack.append(node)
            return
        while stack[-1].foreign and stack[-1].tag not in ("foreignobject", "annotation-xml"):
            stack.pop()
    if tag == "html":
        stack[0].attributes = stack[0].attributes or attributes
        return
    if stack[-1].tag == "head" and tag not in HEAD_ONLY:
        stack.pop()
    if tag == "body" and stack.innermost(("body",)):
        return
    if tag in ENDS_P:
        k = stack.innermost(("p",))
        if k > stack.innermost(KEEPS_P):
            stack.cut(k)
    if tag in IMPLIED:
        ends, limits = IMPLIED[tag]
        k = stack.innermost(ends)
        if k > stack.innermost(limits):
            stack.cut(k)
        # table parts inside one another: a row ends a cell before it ends the row
        if tag in ("tr", "thead", "tbody", "tfoot"):
            while len(stack) > 1 and stack[-1].tag in ("td", "th", "tr") and (tag != "tr" or stack[-1].tag != "tr"):
                stack.pop()
    if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
        _push(stack, Node("tr"))
    node = Node(tag, attributes, tag in FOREIGN)
    stack[-1].children.append(node)
    if tag not in VOID and not (node.foreign and _EMPTY.search(attributes)):
        stack.append(node)


def _push(stack: Stack, node: Node) -> None:
    stack[-1].children.append(node)
    stack.append(node)


def _display(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether a node is laid out, and whether its text can be seen (its children may be visible again)."""
    if node.tag in NEVER_SHOWN or (node.foreign and node.tag in UNDRAWN):
        return False, False
    visible = visible and not (node.foreign and node.tag == "mphantom")
    if not node.attributes:
        return node.tag != "dialog", visible
    attributes = node.get()
    if node.foreign:  # drawings have these as attributes too
        if attributes.get("display", "").lower() == "none":
            return False, False
        if "visibility" in attributes:
            visible = attributes["visibility"].lower() not in ("hidden", "collapse")
    if "hidden" in attributes or (node.tag == "dialog" and "open" not in attributes):
        return False, False
    style = attributes.get("style", "").lower()
    if style:
        rules = dict(re.findall(r"([a-z-]+)\s*:\s*([a-z-]+)", style))
        if rules.get("display") == "none" or rules.get("content-visibility") == "hidden":
            return False, False
        if "visibility" in rules:
            visible = rules["visibility"] not in ("hidden", "collapse")
    return True, visible


class Page:
    """Lines of the layout: text runs collapse blanks, blocks begin lines, spaced blocks stand between blank lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = False  # a blank line is due before the next text
        self.prefix: list[int] = []  # indentation of each open element, those around it included
        self.marker = ""
        self.blank = False  # a blank is due before the next word

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s == " ":
            self.blank = bool(self.run)
            return
        if s[0] == " " or self.blank:
            if self.run:
                self.run.append(" ")
        self.run.append(s.strip(" "))
        self.blank = s[-1] == " "

    def line(self, force: bool = False) -> None:
        """Ends the line, if there is one."""
        if self.run or force:
            self.put("".join(self.run))
        self.run, self.blank = [], False

    def put(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = " " * min(self.prefix[-1] if self.prefix else 0, WIDEST_LEAD)
        if self.marker:
            lead = lead[: len(lead) - len(self.marker)] + self.marker if len(lead) >= len(self.marker) else self.marker
            self.marker = ""
        self.lines.append((lead + s).rstrip())

    def indent(self, width: int) -> None:
        self.prefix.append((self.prefix[-1] if self.prefix else 0) + width)

    def space(self) -> None:
        self.line()
        self.gap = True


def render(root: Node, depth: int = 0, visible: bool = True) -> list[str]:
    """Lines of a tree, without recursion but for tables within tables."""
    page = Page()
    numbers: list[int | None] = []  # of open lists: the next number, None for bullets
    work: list[tuple] = [("node", root, visible, False)]
    while work:
        kind, node, seen, pre = work.pop()
        if kind == "end":
            tag = node.tag
            if node.foreign:
                if tag in ("text", "mtr"):
                    page.line()
                continue
            if tag in LISTS:
                numbers.pop()
                page.line()
                page.gap = page.gap or not numbers
            elif tag in BLOCK:
                page.space() if tag in SPACED else page.line()
            if tag in ("li", "blockquote", "dd"):
                page.line()
                if tag == "li" and page.marker:  # an empty item keeps its marker
                    page.put("")
                page.prefix.pop()
            elif tag == "q" and seen:
                page.run.append("\N{RIGHT DOUBLE QUOTATION MARK}")
            continue
        if isinstance(node, str):
            if seen and node:
                if pre:
                    parts = node.replace("\r\n", "\n").split("\n")
                    for k, part in enumerate(parts):
                        if part:
                            page.run.append(part)
                        if k < len(parts) - 1:
                            page.line(force=True)
                else:
                    page.text(node)
            continue
        shown, seen = _display(node, seen)
        if not shown:
            continue
        tag = node.tag
        if node.foreign:
            if tag in ("text", "mtr"):  # a label of a drawing, a row of a formula
                page.line()
            work.append(("end", node, seen, pre))
            for c in reversed(node.children):
                work.append(("node", c, seen, pre))
                if tag in APART and isinstance(c, Node):
                    work.append(("node", " ", seen, False))
            continue
        if tag == "br":
            page.line(force=bool(page.lines or page.run))
            continue
        if tag == "table" and depth < DEEPEST:
            page.space()
            for line in table_lines(node, depth, seen):
                page.put(line)
            page.gap = True
            continue
        if tag in LISTS:
            page.line() if numbers else page.space()
            start = node.get().get("start", "1") if tag == "ol" else ""
            numbers.append((int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if tag == "ol" else None)
        elif tag == "li":
            page.line()
            marker = "- "
            if numbers and numbers[-1] is not None:
                value = node.get().get("value", "")
                if re.fullmatch(r"-?\d{1,9}", value):
                    numbers[-1] = int(value)
                marker = f"{numbers[-1]}. "
                numbers[-1] += 1
            page.indent(len(marker))
            page.marker = marker
        elif tag in BLOCK:
            page.space() if tag in SPACED else page.line()
            if tag in ("blockquote", "dd"):
                page.indent(INDENT)
        elif tag in ("td", "th", "caption", "tr"):
            page.line()
        elif tag == "q" and seen:
            page.text(" \N{LEFT DOUBLE QUOTATION MARK}" if page.blank else "\N{LEFT DOUBLE QUOTATION MARK}")
        children = node.children
        if tag == "details" and "open" not in node.get():  # closed: its summary alone can be seen
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        pre = pre or tag in ("pre", "xmp", "textarea")
        work.append(("end", node, seen, pre))
        if pre and tag == "pre" and children and isinstance(children[0], str) and children[0][:1] == "\n":
            children = [children[0][1:], *children[1:]]
        work.extend(("node", c, seen, pre) for c in reversed(children))
    page.line()
    return page.lines


def table_lines(table: Node, depth: int, visible: bool) -> list[str]:
    """A table's caption, then its rows with the cells of a column aligned; a cell keeps its lines, loose text stands first."""
    captions, loose, rows = [], [], []  # of a row: its group, and (lines, columns, rows) of its cells
    work = [(c, visible, 0) for c in reversed(table.children)]
    groups = 0
    while work:
        node, seen, group = work.pop()
        if isinstance(node, str):
            if node.strip() and seen:
                loose.append(_SPACE.sub(" ", node).strip())
            continue
        shown, inner = _display(node, seen)
        if not shown or node.tag in ("colgroup", "col"):
            continue
        if node.tag == "caption":
            captions += render(Node("div"), depth + 1) + _cell(node, depth, inner)
        elif node.tag == "tr":
            cells = []
            for c in node.children:
                if isinstance(c, str):
                    if c.strip() and inner:
                        loose.append(_SPACE.sub(" ", c).strip())
                    continue
                ok, cell_seen = _display(c, inner)
                if not ok:
                    continue
                cells.append((_cell(c, depth, cell_seen), min(_span(c, "colspan") or 1, WIDEST_SPAN), _span(c, "rowspan")))
            rows.append((group, cells))
        else:
            groups += 1
            work.extend((c, inner, groups) for c in reversed(node.children))
    placed = _grid(rows)
    widths: dict[int, int] = {}
    wide = lambda lines: min(max(map(len, lines), default=0), WIDEST_COLUMN)
    for cells in placed:
        for column, lines, span in cells:
            widths[column] = max(widths.get(column, 0), wide(lines) if span == 1 else 0)
    columns = sorted(widths)
    # what a cell over several columns needs beyond them widens the last
    for column, lines, span in sorted((c for cells in placed for c in cells if c[2] > 1), key=lambda c: c[2]):
        mine = columns[bisect_left(columns, column) : bisect_left(columns, column + span)]
        widths[mine[-1]] += max(0, wide(lines) - sum(widths[c] for c in mine) - 2 * (len(mine) - 1))
    begins, at = {}, 0
    for c in columns:
        begins[c] = min(at, WIDEST_LINE)
        at += widths[c] + 2
    body = []
    for cells in placed:
        shown = [(begins[column], lines) for column, lines, _ in cells if lines]
        for k in range(max((len(lines) for _, lines in shown), default=0)):
            shown = [x for x in shown if k < len(x[1])]
            line = ""
            for begin, lines in shown:
                if lines[k]:
                    line = (line + "  " if line else "").ljust(begin) + lines[k]
            body.append(line)
    return captions + loose + body


def _span(node: Node, name: str) -> int:
    """A cell's number of columns or rows: 1 where none is told, 0 for all rows left."""
    told = node.get().get(name, "1").strip()
    return min(int(told), 65534) if told.isdecimal() and len(told) < 10 else 1


def _grid(rows: list[tuple[int, list[tuple[list[str], int, int]]]]) -> list[list[tuple[int, list[str], int]]]:
    """By row, (column, lines, columns) of its cells: they take the columns that no cell from above reaches into; groups end cells."""
    out, reach, last = [], {}, None  # reach: rows that a column is still taken for, -1 up to the group's end
    for group, cells in rows:
        if group != last:
            reach, last = {}, group
        column, mine, taken = 0, [], {}
        for lines, span, down in cells:
            while column in reach:
                column += 1
            mine.append((column, lines, span))
            if down != 1:
                taken.update((column + k, down - 1) for k in range(span))
            column += span
        reach = {c: n - 1 for c, n in reach.items() if n != 1} | taken
        out.append(mine)
    return out


def _cell(node: Node, depth: int, visible: bool) -> list[str]:
    inside = Node("div")
    inside.children = node.children
    return render(inside, depth + 1, visible)


def visible_text(page: str | None) -> str:
    """The layout as one text; null and empty pages give an empty one."""
    return "\n".join(render(parse(page))).strip("\n") if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars, n_lines) of each row of `pages` (page_id, html); rows are kept one by one, null ids too."""
    tuned(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            texts = [visible_text(h) for h in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("page_id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                ],
                ["page_id", "text", "n_chars", "n_lines"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, OUT)


def op8_html(pages: DataFrame) -> DataFrame:
    return extract(pages)
