"""HTML extraction: a tree with implied tags, rendered to all of its visible text.

The tree builder reads tags and text in one pass and opens and closes what HTML
leaves out (``</p>``, ``</li>``, ``</td>``, ``</head>``, a table's body and rows). The renderer
leaves out what a reader would not see (scripts, styles, ``hidden``, and
``display:none`` or ``visibility:hidden`` in an element's own style; rules of
style sheets are not applied), puts blocks on lines of their own, marks list items, and
sets table cells in aligned columns.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INVISIBLE = frozenset("script style template head title noscript noembed noframes iframe object audio video canvas svg datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
#: Blocks set off by an empty line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: Start tags that end an open element of these names, up to the nearest of the borders.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "tr"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "tr"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "tr"}, {"table"}), "body": ({"head"}, {"html"}),
}
_ENDS_P = BLOCK - {"html", "body", "option", "optgroup", "legend"}
#: What a head may hold; any other start tag, and text, ends it.
_IN_HEAD = frozenset("base link meta title style script noscript noframes template".split())
_P_BORDER = frozenset({"td", "th", "table", "button", "object", "caption"})
#: Tables within tables beyond this depth are rendered as blocks without columns.
DEEPEST_TABLE = 16
#: A wider cell does not widen its column; columns are aligned if that takes no more than so many times the table's text.
WIDEST, PADDING = 120, 20
_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HIDDEN_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("name", "hidden", "children", "attrs")

    def __init__(self, name: str, hidden: bool = False, attrs: dict[str, str] | None = None):
        self.name, self.hidden, self.attrs = name, hidden, attrs or {}
        self.children: list[Node | str] = []


def build_tree(source: str) -> Node:
    root = Node("#root")
    stack = [root]
    at, size = 0, len(source)

    def text(piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            if stack[-1].name == "head" and piece.strip(" \t\n\f\r"):
                cut(len(stack) - 1)
            stack[-1].children.append(piece)

    opened: Counter[str] = Counter()

    def cut(k: int) -> None:
        opened.subtract(n.name for n in stack[k:])
        del stack[k:]

    def close(names: set[str] | frozenset[str], borders: set[str] | frozenset[str]) -> None:
        """Close open elements of these names, the nearest border being the limit."""
        k = len(stack) - 1
        while k > 0 and any(opened[n] > 0 for n in names) and stack[k].name not in borders:
            if stack[k].name in names:
                cut(k)
            k -= 1

    def open_(name: str, attrs: dict[str, str] | None = None, hidden: bool = False) -> None:
        node = Node(name, hidden, attrs)
        stack[-1].children.append(node)
        stack.append(node)
        opened[name] += 1

    while at < size:
        m = _TAG.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at:m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "p" and opened["p"] <= 0:
                open_("p")
            if opened[name] <= 0:
                continue
            borders = {"table"} if name not in ("table", "body", "html") else set()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    cut(k)
                    break
                if stack[k].name in borders and name not in ("caption", "td", "th", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[3])} if m[3].strip(" /") else {}
        hidden = "hidden" in attrs or bool(_HIDDEN_STYLE.search(attrs.get("style", ""))) or (name == "input" and attrs.get("type", "").lower() == "hidden")
        if stack[-1].name == "head" and name not in _IN_HEAD:
            cut(len(stack) - 1)
        if name in _ENDS_P:
            close({"p"}, _P_BORDER)
        if name in IMPLIED_END:
            close(*IMPLIED_END[name])
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            open_("tr")
        if name in VOID:
            stack[-1].children.append(Node(name, hidden, attrs))
            continue
        open_(name, attrs, hidden)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            piece = source[at:end.start()] if end else source[at:]
            at = end.end() if end else size
            if name in ("textarea", "title"):
                text(piece)
            cut(len(stack) - 1)
    return root


class _Out:
    """Lines with collapsed white space; blocks ask for line ends, not write them."""

    def __init__(self, pre: bool = False):
        self.parts: list[str] = []
        self.want, self.space, self.fresh = 0, False, True

    def block(self, lines: int) -> None:
        self.want = max(self.want, lines)
        self.space = False

    def line_break(self) -> None:
        self.parts.append("\n")
        self.space, self.fresh = False, True

    def _start(self) -> None:
        if self.want and self.parts:
            tail = "".join(self.parts[-2:])
            have = len(tail) - len(tail.rstrip("\n"))
            self.parts.append("\n" * max(0, self.want - have))
            self.fresh = True
        self.want = 0

    def text(self, piece: str, pre: bool) -> None:
        if pre:
            self._start()
            self.parts.append(piece)
            self.fresh = piece.endswith("\n")
            return
        flat = _SPACE.sub(" ", piece)
        if flat == " " or not flat:
            self.space = self.space or bool(flat)
            return
        lead = flat[0] == " " or self.space
        self._start()
        if lead and not self.fresh:
            self.parts.append(" ")
        self.parts.append(flat.strip(" "))
        self.fresh, self.space = False, flat[-1] == " "

    def raw(self, piece: str) -> None:
        self._start()
        self.parts.append(piece)
        self.fresh, self.space = piece.endswith((" ", "\n")), False

    def result(self) -> str:
        return "\n".join(line.rstrip(" ") for line in "".join(self.parts).split("\n")).strip("\n")


def _hidden(node: Node) -> bool:
    return node.hidden or node.name in INVISIBLE


def _render(node: Node, out: _Out, pre: bool, lists: list[list], tables: int = 0) -> None:
    # an explicit stack: pages may nest deeper than Python recurses
    todo: list[tuple] = [("open", node, pre)]
    while todo:
        what, item, pre = todo.pop()
        if what == "text":
            out.text(item, pre)
        elif what == "end":
            if item.name in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            if item.name in BLOCK:
                out.block(2 if item.name in SPACED and not lists else 1)
            if item.name == "q":
                out.text('"', False)
        else:
            if _hidden(item):
                continue
            name = item.name
            if name == "br":
                out.line_break()
                continue
            if name == "hr":
                out.block(1)
                out.raw("----")
                out.block(1)
                continue
            if name == "img":
                if item.attrs.get("alt"):
                    out.text(html.unescape(item.attrs["alt"]), False)
                continue
            if name == "table" and tables < DEEPEST_TABLE:
                out.block(2)
                grid = _table(item, tables + 1)
                if grid:
                    out.raw(grid)
                out.block(2)
                continue
            if name in BLOCK:
                out.block(2 if name in SPACED and not lists else 1)
            if name in ("ul", "menu", "dir"):
                lists.append(["-", 0])
            elif name == "ol":
                start = item.attrs.get("start", "1")
                lists.append(["#", int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0])
            elif name == "li":
                own = lists[-1] if lists else ["-", 0]
                own[1] += 1
                out.raw("  " * max(0, len(lists) - 1) + (f"{own[1]}. " if own[0] == "#" else "- "))
            elif name == "q":
                out.text('"', False)
            inner = pre or name in ("pre", "textarea")
            todo.append(("end", item, pre))
            todo += [("text", c, inner) if isinstance(c, str) else ("open", c, inner) for c in reversed(item.children)]


def _span(cell: Node, name: str, most: int) -> int:
    """A colspan or rowspan as HTML reads it; a rowspan of zero goes on to the end."""
    value = cell.attrs.get(name, "1").strip()
    n = min(int(value), most) if re.fullmatch(r"\d{1,9}", value) else 1
    return n or (most if name == "rowspan" else 1)


def _rows(table: Node, tables: int) -> tuple[list[str], list[list[tuple[int, str]]]]:
    """Captions, and rows of (column, text); columns that spans take up are left out."""
    captions, rows = [], []
    taken: list[tuple[int, int, int]] = []  # columns from, to, and the first row that has them free again
    todo = list(reversed(table.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if node.strip():
                captions.append(_SPACE.sub(" ", node).strip())
        elif _hidden(node):
            continue
        elif node.name in ("tbody", "thead", "tfoot", "colgroup"):
            todo += reversed(node.children)
        elif node.name == "tr":
            cells: list[tuple[int, str]] = []
            now = len(rows)
            held = iter(sorted(x for x in taken if x[2] > now))
            nxt = next(held, None)
            kept, column = [x for x in taken if x[2] > now + 1], 0
            for c in node.children:
                if isinstance(c, str) and not c.strip() or not isinstance(c, str) and _hidden(c):
                    continue
                while nxt and nxt[0] <= column:
                    column, nxt = max(column, nxt[1]), next(held, None)
                if isinstance(c, str):
                    cells.append((column, _SPACE.sub(" ", c).strip()))
                    column += 1
                    continue
                cells.append((column, _cell(c, tables)))
                to, down = column + _span(c, "colspan", 1_000), _span(c, "rowspan", 65_534)
                if down > 1:
                    last = kept[-1] if kept else None
                    if last and last[1] == column and last[2] == now + down:
                        kept[-1] = (last[0], to, last[2])
                    else:
                        kept.append((column, to, now + down))
                column = to
            taken = kept
            rows.append(cells)
        else:
            captions.append(_cell(node, tables))
    return captions, rows


def _cell(node: Node, tables: int) -> str:
    out = _Out()
    inner = Node("#cell")
    inner.children = node.children if node.name in ("td", "th", "caption") else [node]
    _render(inner, out, False, [], tables)
    return out.result()


def _table(table: Node, tables: int) -> str:
    """Captions, then rows with cells padded to their column; a cell's lines stay in it.

    Cells of over ``WIDEST`` characters do not widen their column. A table whose
    padding would take over ``PADDING`` times its text is written without.
    """
    captions, rows = _rows(table, tables)
    split = [[(k, cell.split("\n")) for k, cell in row] for row in rows]
    width: dict[int, int] = {}
    for row in split:
        for k, cell in row:
            width[k] = max(width.get(k, 0), *(len(x) if len(x) <= WIDEST else 0 for x in cell))
    columns = max(width, default=-1) + 1
    tall = sum(max([1, *(len(cell) for _, cell in row)]) for row in split)
    text = sum(len(x) for row in rows for _, x in row)
    aligned = tall * (3 * columns + sum(width.values())) <= PADDING * (text + tall + 100)
    lines = [c for c in captions if c]
    for row in split:
        for n in range(max([1, *(len(cell) for _, cell in row)])):
            here = {k: cell[n] for k, cell in row if n < len(cell)}
            if aligned:
                upto = max((k for k, x in row), default=-1) + 1
                lines.append(" | ".join(here.get(k, "").ljust(width.get(k, 0)) for k in range(upto)).rstrip())
            else:
                lines.append(" | ".join(x for x in here.values() if x))
    return "\n".join(lines)


def visible_text(source: str | None) -> str:
    """All visible text of a page; empty for null, empty or invisible pages."""
    if not source:
        return ""
    out = _Out()
    _render(build_tree(source), out, False, [])
    return out.result()


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the visible text of each whole page.

    Null and empty pages give an empty text; malformed markup never fails: what
    is not a tag is text. Cells of tables nested more than ``DEEPEST_TABLE``
    deep are set as blocks. Rows and other columns stay; a column named
    ``out_col`` is replaced.
    """

    @F.pandas_udf("string")
    def render(source: pd.Series) -> pd.Series:
        return source.map(visible_text, na_action=None)

    return pages.withColumn(out_col, render(F.col(html_col)))
