"""Visible text of HTML pages, laid out as blocks, lists and aligned tables.

Three steps for each page, all of them iterative, so that neither depth nor
length of a page is limited: a scanner gives tags and text; a tree builder adds
implied ends (a list item ends its predecessor, a block ends a paragraph, a row
ends its cells ...) and ignores ends without a start; a renderer walks the tree.

* Not visible: head, script, style, template, noscript and other elements of
  ``UNSEEN``, comments, and subtrees with the ``hidden`` attribute or a style of
  ``display: none`` or ``visibility: hidden``.
* Inline text has its white space collapsed; a block begins a new line; blocks
  with margins are parted by one blank line; ``pre`` keeps its white space.
* List items carry ``- `` or their number, nested lists are indented.
* A table's cells are padded to the width of their column and parted by two
  spaces; a cell of several lines keeps them; colspan takes that many columns.

Null pages give null, empty pages and pages without visible text give ''.
Repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from hushframe.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript noframes iframe object audio video canvas svg math datalist title meta link base".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure form fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address li dt dd tr td th thead tbody tfoot caption figcaption details summary legend hr option optgroup select textarea center dialog menu search".split())
#: A start tag -> the open elements that it ends, and those that it looks no further than.
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
_END_P = (frozenset(["p"]), frozenset("td th li dd dt div section article blockquote table body button object caption".split()))
#: Elements that an end tag of another name does not reach across.
_WALLS = frozenset(["td", "th", "table", "caption"])
_IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_WHITE = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "hidden", "span", "down", "start", "children")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.hidden, self.span, self.down, self.start = tag, tag in UNSEEN, 1, 1, 1
        self.children: list[Node | str] = []
        if attributes and not attributes.isspace():
            for name, *values in _ATTR.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name == "hidden" or (name == "style" and _STYLE.search(html.unescape(value))) or (tag == "input" and name == "type" and value.lower() == "hidden"):
                    self.hidden = True
                elif name == "colspan" and value.isascii() and value.isdigit():
                    self.span = min(max(int(value[:6]), 1), 1000)
                elif name == "rowspan" and value.isascii() and value.isdigit():
                    self.down = min(int(value[:6]), 65_534)
                elif name == "start" and tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", value):
                    self.start = int(value)


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('start', tag, attributes) and ('end', tag, '') in order."""
    at, n, loose, comments = 0, len(page), False, True
    while at < n:
        left = page.find("<", at)
        if left < 0:
            yield "text", page[at:], ""
            return
        if left > at:
            yield "text", page[at:left], ""
        if page.startswith("<!--", left):
            end = page.find("-->", left + 4) if comments else -1
            if end < 0:
                comments, end = False, page.find(">", left)
                at = n if end < 0 else end + 1
            else:
                at = end + 3
            continue
        if page.startswith(("<!", "<?"), left):
            end = page.find(">", left)
            at = n if end < 0 else end + 1
            continue
        found = None if loose else _TAG.match(page, left)
        if found is None:
            found = _LOOSE.match(page, left)
            # a quote that never closes would be searched for at each tag
            loose = loose or found is not None
        if found is None:
            yield "text", "<", ""
            at = left + 1
            continue
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            yield "end", tag, ""
            continue
        yield "start", tag, found[3]
        if tag in RAW and not found[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            end = n if close is None else close.start()
            yield "text", page[at:end], tag
            yield "end", tag, ""
            if close is None:
                return
            right = page.find(">", end)
            at = n if right < 0 else right + 1


def build(page: str) -> Node:
    """The tree of a page, with implied ends and without stray ones."""
    root = Node("#root")
    stack = [root]
    open_count: dict[str, int] = {}

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_count[stack.pop().tag] -= 1

    def end_implied(names: frozenset[str], walls: frozenset[str]) -> None:
        if not any(open_count.get(x) for x in names):
            return
        low = None
        for depth in range(len(stack) - 1, 0, -1):
            tag = stack[depth].tag
            if tag in walls:
                break
            if tag in names:
                low = depth
        if low is not None:
            close(low)

    for kind, name, extra in scan(page):
        if kind == "text":
            if stack[-1].tag == "head" and name.strip():
                close(len(stack) - 1)
            stack[-1].children.append(name if extra in ("script", "style") else html.unescape(name))
        elif kind == "start":
            if open_count.get("head") and name not in _IN_HEAD and name not in ("head", "html"):
                end_implied(frozenset(["head"]), frozenset())
            if name in ENDS:
                end_implied(*ENDS[name])
            if name in BLOCK and name not in ("li", "option", "optgroup"):
                end_implied(*_END_P)
            node = Node(name, extra)
            stack[-1].children.append(node)
            if name not in VOID:
                stack.append(node)
                open_count[name] = open_count.get(name, 0) + 1
        elif open_count.get(name):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == name:
                    close(depth)
                    break
                if stack[depth].tag in _WALLS and name not in ("table", "tr", "thead", "tbody", "tfoot", "html", "body"):
                    break
        elif name == "br":
            stack[-1].children.append(Node("br"))
    return root


class Flow:
    """Lines under construction: inline pieces, breaks, and blank lines between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False
        self.mark = ""

    def text(self, piece: str) -> None:
        self.inline.append(piece)

    def end_line(self, force: bool = False) -> None:
        line = _WHITE.sub(" ", "".join(self.inline)).strip(" ")
        self.inline = []
        if line or self.mark.strip():
            self.put(self.mark + line)
        elif force and self.lines and not self.gap:
            self.put("")

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)
        self.mark = ""

    def space(self) -> None:
        self.end_line()
        self.gap = True

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def render(root: Node) -> str:
    """The visible text of a tree."""
    flows = [Flow()]
    lists: list[list[int | None]] = []
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    todo: list[tuple[str, Node | str]] = [("in", root)]
    pre = 0
    while todo:
        step, node = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if pre:
                first, *rest = node.replace("\r\n", "\n").split("\n")
                flow.inline.append(first)
                for line in rest:
                    flow.put(flow.mark + "".join(flow.inline).rstrip())
                    flow.inline = [line]
            else:
                flow.text(node)
            continue
        tag = node.tag
        if step == "in":
            if node.hidden:
                continue
            if tag == "br":
                flow.end_line(force=True)
                continue
            if tag == "wbr" or tag in VOID:
                if tag == "hr":
                    flow.space()
                continue
            if tag in ("td", "th") or (tag == "li" and lists) or tag == "table" or tag in ("dd", "blockquote"):
                if tag == "table":
                    flow.space()
                    tables.append([])
                elif tag not in ("td", "th"):
                    flow.space() if tag == "blockquote" else flow.end_line()
                flows.append(Flow())
            elif tag == "tr":
                if tables:
                    tables[-1].append([])
            elif tag in SPACED:
                # a list inside an item follows it without a blank line
                flow.end_line() if tag in ("ul", "ol") and lists else flow.space()
            elif tag in BLOCK:
                flow.end_line()
            if tag in ("ul", "ol", "menu"):
                lists.append([node.start if tag == "ol" else None])
            pre += tag in ("pre", "textarea", "xmp")
            todo.append(("out", node))
            todo.extend(("in", child) for child in reversed(node.children))
            continue
        if tag in ("pre", "textarea", "xmp"):
            if "".join(flow.inline).strip():
                flow.put(flow.mark + "".join(flow.inline).rstrip())
            flow.inline = []
            pre -= 1
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        if tag == "table":
            outside = flows.pop().done()
            up = flows[-1]
            for line in [*outside, *_table(tables.pop())]:
                up.put(line)
            up.gap = True
        elif tag in ("td", "th"):
            lines = flows.pop().done()
            if tables:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((lines, node.span, node.down))
            else:
                for line in lines:
                    flows[-1].put(line)
        elif tag == "li" and lists:
            lines = flows.pop().done()
            number = lists[-1][0]
            mark = "- " if number is None else f"{number}. "
            if number is not None:
                lists[-1][0] = number + 1
            for i, line in enumerate(lines):
                flows[-1].put((mark if i == 0 else " " * len(mark)) + line if line else "")
        elif tag in ("dd", "blockquote"):
            lines = flows.pop().done()
            for line in lines:
                flows[-1].put("  " + line if line else "")
            if tag == "blockquote":
                flows[-1].gap = True
        elif tag in SPACED:
            flow.end_line() if tag in ("ul", "ol") and lists else flow.space()
        elif tag in BLOCK:
            flow.end_line()
    return "\n".join(line.rstrip() for line in flows[0].done())


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns, rows) as lines with aligned columns.

    A cell that goes down over further rows has its text in the first and keeps its
    columns in the others; 0 rows are all that follow.  Rows without text give no line.
    """
    taken: dict[int, tuple[int, int]] = {}  # column -> (column behind the cell, row below it)
    told: list[list[tuple[list[str], int, int]]] = []
    for r, row in enumerate(rows):
        at = 0
        cells: list[tuple[list[str], int, int]] = []
        for lines, span, down in row:
            while at in taken and taken[at][1] > r:
                cells.append(([], at, taken[at][0] - at))
                at = taken[at][0]
            cells.append((lines, at, span))
            if down != 1:
                taken[at] = (at + span, r + down if down else len(rows))
            at += span
        if any(lines for lines, _, _ in cells):
            told.append(cells)
    width: dict[int, int] = {}
    for cells in told:
        for lines, at, span in cells:
            if span == 1:
                width[at] = max(width.get(at, 0), *(len(x) for x in lines), 0)
    out = []
    for cells in told:
        room = [sum(width.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1) for _, at, span in cells]
        for k in range(max(len(lines) for lines, _, _ in cells)):
            parts = [(lines[k] if k < len(lines) else "").ljust(n) for (lines, _, _), n in zip(cells, room, strict=True)]
            out.append("  ".join(parts).rstrip())
    return out


def extract(page: str) -> str:
    return render(build(page))


def extract_text(df: DataFrame, source: str = "html", key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, text): the visible text of every row's page."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if p.as_py() is None else extract(p.as_py()) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[key, text])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, source).mapInArrow(run, f"`{key}` {kind}, `{text}` string")
