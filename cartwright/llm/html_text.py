"""Visible text of HTML pages, laid out as a reader sees it.

A page is read into a tree (missing end and start tags are implied), the tree is walked without what
is not displayed, and each block is laid out: paragraphs are set apart by an empty line, list items
get bullets or numbers and their depth, and the cells of a table's column share one width. Time grows
with the page and what it becomes, not with its depth: open elements are counted by name, and lines of
inner blocks are handed on as they are and get their indents at the end.

Style sheets are not read; attributes and inline styles are.
"""

import html
import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext textarea title".split())
UNSEEN = frozenset(
    "head script style template noscript iframe noembed noframes object audio video canvas svg math "
    "datalist title meta link base map area param source track".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section summary table caption tbody tfoot thead tr td th ul".split()
)
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr menu dir".split())
#: A start tag of the key ends an open element of the values, up to the scope's border.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
#: Start tags that end an open paragraph.
END_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary "
    "table ul li dt dd".split()
)
#: An end tag looks for its element no further than to one of these.
SCOPE = frozenset("table td th caption html template button".split())
TABLE_PARTS = frozenset("table caption colgroup tbody thead tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNDISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
#: Marks and indents of inner blocks stop growing at so many columns, else deep pages grow by their depth squared.
MOST_INDENT = 160
#: A cell spans at most so many columns; cells that begin further right span one row.
MOST_COLUMNS = 1000
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    """An element, or a piece of text (``name`` empty, its text in ``text``)."""

    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    text: str = ""
    children: list["Node"] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, plain in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(double or single or plain))
    return found


class _Builder:
    """The tree under construction: the path of open elements."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.depths: dict[str, list[int]] = {}  # of the open elements of each name

    def close_to(self, depth: int) -> None:
        for _ in range(len(self.open) - max(depth, 1)):
            self.pop()

    def pop(self) -> None:
        self.depths[self.open.pop().name].pop()

    def _deepest(self, names) -> int:
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def find(self, names, border) -> int:
        """The depth of the innermost open element of these names within the border, or 0."""
        depth = self._deepest(names)
        return depth if depth >= self._deepest(border) else 0

    def add_text(self, text: str) -> None:
        if text:
            parent = self.open[-1]
            if parent.name in ("table", "tbody", "thead", "tfoot", "tr") and text.strip(" \t\n\r\f"):
                self._before_table(Node("", text=text))
            else:
                parent.children.append(Node("", text=text))

    def _before_table(self, node: Node) -> None:
        """Content where only rows may stand is moved in front of the table."""
        depth = self.find({"table"}, ())
        if not depth:  # rows or sections without a table
            self.open[-1].children.append(node)
            return
        parent, table = self.open[depth - 1], self.open[depth]
        last = bool(parent.children) and parent.children[-1] is table
        parent.children.insert(len(parent.children) - last, node)

    def start(self, name: str, attributes: dict[str, str]) -> Node | None:
        if name in ("html", "body"):
            self.root.attributes |= {k: v for k, v in attributes.items() if k not in self.root.attributes}
            if name == "body":
                self._leave_head()
            return None
        if self.open[-1].name == "head" and name not in UNSEEN:
            self._leave_head()
        if name in ENDS:
            names, border = ENDS[name]
            while depth := self.find(names, border):
                self.close_to(depth)
        if name in END_P and (depth := self.find({"p"}, SCOPE)):
            self.close_to(depth)
        if name in HEADINGS and self.open[-1].name in HEADINGS:
            self.pop()
        if name == "a" and (depth := self.find({"a"}, SCOPE)):
            self.close_to(depth)
        if name in ("td", "th") and self.open[-1].name in ("table", "tbody", "thead", "tfoot"):
            self._push(Node("tr"))
        node = Node(name, attributes)
        if name in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)
        return node

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.depths.setdefault(node.name, []).append(len(self.open))
        self.open.append(node)

    def _leave_head(self) -> None:
        if depth := self.find({"head"}, ()):
            self.close_to(depth)

    def end(self, name: str) -> None:
        if name == "br":  # read as <br>
            self.open[-1].children.append(Node("br"))
        elif name in ("html", "body"):
            return
        elif name in HEADINGS:
            if depth := self.find(HEADINGS, SCOPE):
                self.close_to(depth)
        elif depth := self.find({name}, ({"table"} if name in TABLE_PARTS else SCOPE) - {name}):
            self.close_to(depth)


def tree(source: str) -> Node:
    """The page as a tree under one root; every text is read, however broken the page is."""
    builder, at = _Builder(), 0
    while match := _TOKEN.search(source, at):
        builder.add_text(html.unescape(source[at : match.start()]))
        at = match.end()
        if not match[2]:
            continue
        name = match[2].lower()
        if match[1]:
            builder.end(name)
            continue
        node = builder.start(name, _attributes(match[3]))
        if name in RAW and node is not None:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            inner = source[at : end.start() if end else len(source)]
            node.children.append(Node("", text=html.unescape(inner) if name in ("textarea", "title") else inner))
            builder.pop()
            at = end.end() if end else len(source)
        elif node is not None and match[3].endswith("/") and name not in VOID and name in ("svg", "math"):
            builder.pop()
    builder.add_text(html.unescape(source[at:]))
    return builder.root


def displayed(node: Node) -> bool:
    """Whether an element has a place on the page."""
    if node.name in UNSEEN or "hidden" in node.attributes:
        return False
    if node.name == "dialog" and "open" not in node.attributes:
        return False
    if node.name == "input" and node.attributes.get("type", "").lower() == "hidden":
        return False
    return not _UNDISPLAYED.search(node.attributes.get("style", ""))


def _seen(node: Node, seen: bool) -> bool:
    """Whether what an element holds is seen, if what is around it is ``seen``."""
    found = _VISIBILITY.search(node.attributes.get("style", ""))
    return found[1].lower() == "visible" if found else seen


def _width(text: str) -> int:
    """Columns of a text on a grid: wide characters take two, marks none."""
    if text.isascii():
        return len(text)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text
    )


@dataclass
class _Inner:
    """Lines of an inner block, the first one behind a mark, the others as deep; never empty."""

    lines: list
    first: str
    others: str


def _flat(lines: list) -> list[str]:
    """All lines with the marks and indents of the blocks around them."""
    out: list[str] = []
    stack = [(iter(lines), "", "")]
    while stack:
        here, first, others = stack.pop()
        for line in here:
            if isinstance(line, _Inner):
                stack.append((here, others, others))
                inner_first = first + line.first if len(first) < MOST_INDENT else first
                inner_others = others + line.others if len(others) < MOST_INDENT else others
                stack.append((iter(line.lines), inner_first, inner_others))
                break
            out.append(f"{first}{line}".rstrip())
            first = others
    return out


class _Layout:
    """Lines of a block: text flows into the open line, blocks begin new ones."""

    def __init__(self):
        self.lines: list[str | _Inner] = []
        self.line: list[str] = []
        self.gap = False  # an empty line is due before the next text
        self.space = False  # a space is due before the next text of the line

    def flow(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if not words:
            return
        if words[0] == " ":
            self.space = True
        body = words.strip(" ")
        if body:
            if self.line and self.space:
                self.line.append(" ")
            self._begin()
            self.line.append(body)
            self.space = words[-1] == " "

    def _begin(self) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False

    def as_is(self, text: str) -> None:
        """Preformatted text: its lines and spaces stay."""
        first, *others = text.expandtabs(8).replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self._begin()
            self.line.append(first)
        for line in others:
            if not self.line and not self.gap:
                self.lines.append("")
            self.end_line()
            if line:
                self._begin()
                self.line.append(line)
        self.space = False

    def end_line(self, spaced: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = False
        self.gap = self.gap or spaced

    def break_line(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines and not self.gap:
            self.lines.append("")

    def block(self, lines: list, first: str = "", others: str = "") -> None:
        """Lines of an inner block, the first one behind a mark, the others as deep."""
        self.end_line()
        if lines:
            self._begin()
            self.lines.append(_Inner(lines, first, others))

    def done(self) -> list:
        """The lines from the first to the last that is not empty; inner blocks have some."""
        self.end_line()
        lines = [line if isinstance(line, _Inner) else line.rstrip() for line in self.lines]
        end = len(lines)
        while end and not lines[end - 1]:
            end -= 1
        begin = 0
        while begin < end and not lines[begin]:
            begin += 1
        return lines[begin:end]


@dataclass
class _Cell:
    lines: list
    columns: int = 1
    rows: int = 1


def _grid(rows: list[list[_Cell]]) -> list[list[tuple[int, _Cell]]]:
    """Each row's cells with their columns: a cell takes the first free ones, also in the rows below
    that it spans."""
    out: list[list[tuple[int, _Cell]]] = []
    taken: dict[int, int] = {}  # rows a column is taken for, from this one on
    for row in rows:
        placed, column = [], 0
        below: dict[int, int] = {}
        for cell in row:
            while column in taken:
                column += 1
            placed.append((column, cell))
            if cell.rows > 1 and column < MOST_COLUMNS:
                below |= dict.fromkeys(range(column, column + cell.columns), cell.rows - 1)
            column += cell.columns
        out.append(placed)
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | below
    return out


def _cells(rows: list[list[_Cell]]) -> list:
    """A table's lines: the cells of a column are as wide as the widest, two spaces between.

    Columns in which no cell begins take no room. In a table of one column nothing is aligned, and its
    cells stand as they are.
    """
    grid = [row for row in _grid(rows) if any(cell.lines for _, cell in row)]
    starts = sorted({column for row in grid for column, _ in row})
    if len(starts) < 2:
        return [line for row in grid for _, cell in row for line in cell.lines]
    place = {column: i for i, column in enumerate(starts)}
    flat = [[(place[column], _flat(cell.lines)) for column, cell in row] for row in grid]
    widths = [0] * len(starts)
    for row in flat:
        for at, lines in row:
            widths[at] = max([widths[at], *map(_width, lines)])
    out = []
    for row in flat:
        for n in range(max(len(lines) for _, lines in row)):
            parts, at = [], 0
            for column, lines in row:
                parts += [" " * widths[i] for i in range(at, column)]
                line = lines[n] if n < len(lines) else ""
                parts.append(line + " " * (widths[column] - _width(line)))
                at = column + 1
            out.append("  ".join(parts).rstrip())
    return out


@dataclass
class _Frame:
    """An element being laid out; ``layout`` is shared with its parent unless it stands apart.
    ``table`` and ``list_`` are the nearest around it or itself, ``item`` tells of any list item."""

    node: Node
    layout: _Layout
    place: int = 0
    pre: bool = False
    seen: bool = True
    number: int = 0
    rows: list[list[_Cell]] | None = None
    table: "_Frame | None" = None
    list_: "_Frame | None" = None
    item: bool = False
    summary: bool = False  # of a closed details, met already


_LISTS = ("ul", "ol", "menu", "dir")


def render(root: Node) -> str:
    """The displayed text of a tree. Walks with a stack of its own, so any depth is fine."""
    top = _Frame(root, _Layout(), seen=_seen(root, True))
    stack = [top]
    while stack:
        frame = stack[-1]
        if frame.place < len(frame.node.children):
            child = frame.node.children[frame.place]
            frame.place += 1
            if frame.node.name == "details" and "open" not in frame.node.attributes:
                if child.name != "summary" or frame.summary:
                    continue
                frame.summary = True
            if not child.name:
                if not frame.seen:
                    continue
                if frame.pre:
                    frame.layout.as_is(child.text)
                else:
                    frame.layout.flow(child.text)
            elif displayed(child):
                _enter(child, frame, stack)
            continue
        stack.pop()
        if stack:
            _leave(frame, stack[-1])
    return "\n".join(_flat(top.layout.done()))


def _spaced(name: str, around: _Frame) -> bool:
    return name in SPACED and not (name in _LISTS and around.item)


def _enter(node: Node, frame: _Frame, stack: list[_Frame]) -> None:
    name, layout, seen = node.name, frame.layout, _seen(node, frame.seen)
    if name in VOID:
        if not seen:
            return
        if name == "br":
            layout.break_line()
        elif name == "hr":
            layout.end_line(True)
            layout.block(["---"])
            layout.end_line(True)
        elif name == "img":
            layout.flow(node.attributes.get("alt", ""))
        elif name == "input":
            if node.attributes.get("type", "text").lower() not in ("checkbox", "radio", "password", "file"):
                layout.flow(f" {node.attributes.get('value', '')} ")
        return
    inner = _Frame(
        node, layout, pre=frame.pre or name in ("pre", "textarea"), seen=seen, table=frame.table, list_=frame.list_,
        item=frame.item or name == "li",
    )
    if name in ("li", "td", "th", "blockquote", "dd", "table", "caption"):
        inner.layout = _Layout()
    if name in BLOCKS:
        layout.end_line(_spaced(name, frame))
    if name == "table":
        inner.rows, inner.table = [], inner
    if name in _LISTS:
        inner.list_ = inner
    if name == "ol":
        start = node.attributes.get("start", "1")
        inner.number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    if name == "tr" and frame.table is not None:
        frame.table.rows.append([])
    stack.append(inner)


def _span(node: Node, name: str, most: int) -> int:
    """How many columns or rows a cell spans; 1 where that is no number."""
    value = node.attributes.get(name, "1")
    return min(max(int(value), 1), most) if value.isdigit() and value.isascii() and len(value) < 6 else 1


def _leave(frame: _Frame, around: _Frame) -> None:
    node, outer = frame.node, around.layout
    name = node.name
    if name in ("td", "th"):
        table = around.table
        if table is None:
            outer.block(frame.layout.done())
        else:
            if not table.rows:
                table.rows.append([])
            cell = _Cell(frame.layout.done(), _span(node, "colspan", MOST_COLUMNS), _span(node, "rowspan", 65534))
            table.rows[-1].append(cell)
    elif name == "caption":
        outer.block(frame.layout.done())
    elif name == "table":
        outer.block(frame.layout.done() + _cells(frame.rows))
    elif name == "li":
        list_ = around.list_
        if list_ is not None and list_.node.name == "ol":
            value = node.attributes.get("value", "")
            if re.fullmatch(r"-?\d{1,9}", value):
                list_.number = int(value)
            mark = f"{list_.number}. "
            list_.number += 1
        else:
            mark = "- "
        outer.block(frame.layout.done(), mark, " " * len(mark))
    elif name == "blockquote":
        outer.block(frame.layout.done(), "> ", "> ")
    elif name == "dd":
        outer.block(frame.layout.done(), "    ", "    ")
    if name in BLOCKS:
        outer.end_line(_spaced(name, around))


def page_text(source) -> str:
    """The displayed text of a page; null and empty pages have none."""
    return render(tree(source)) if isinstance(source, str) and source else ""


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """The pages with ``text``: all that is displayed, laid out in lines.

    Null and empty pages have the empty text; every other page has some result, however broken or
    long it is. Rows keep their number and other columns; a ``text`` of the input is replaced.
    """

    @F.pandas_udf("string")
    def read(sources: pd.Series) -> pd.Series:
        return pd.Series([page_text(s) for s in sources], dtype=object)

    return pages.withColumn("text", read(F.col(column)))
