"""HTML extraction by layout-aware rendering: a tree builder, visibility rules, and a text layout.

The tree builder supplies implied tags (a block closes an open paragraph, an item its predecessor, a cell
its row's open cell, text or a tag of the body the head) and closes what is left open. Hidden are the head, scripts, styles, templates,
noscript, and elements with `hidden`, `display:none` or `visibility:hidden`. All other text is
emitted, navigation included: blocks on lines of their own, paragraphs and headings with a blank line around
them, list items with bullets or numbers and an indent by depth, table cells in aligned columns,
preformatted text as it is; elsewhere white space collapses.

Time and output grow in proportion to the page: nothing recurses, every pattern stops at the
next "<", open elements are found by their name, indents end at INDENT levels, tables nested deeper than NESTED are plain blocks, columns are at most
WIDE characters wide (wider cells take lines of their own), and a row that would need more than PADDING spaces for each character of it is not aligned.

Defined cases: null and empty pages give an empty text; a character reference beyond Unicode is U+FFFD; a repeated row is rendered again; unknown tags are inline. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The names of HTML's elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title object iframe audio video canvas datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCKS = PARAGRAPHS | frozenset("html body div section article aside header footer nav main address fieldset form li dt dd tr caption thead tbody tfoot figcaption details summary legend center option optgroup dir menu".split())
#: What may stand in a head.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
INDENT, NESTED, WIDE, PADDING = 32, 16, 60, 32
#: A start tag closes open elements of these names, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?][^<>]*+>|[^<]++|<""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_LONG_NUMBER = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{8,}));?")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^<>]*>", re.I) for name in RAW}


def resolved(text: str) -> str:
    """A text with its character references resolved; numbers are cut to what Unicode can have first, however many digits they have."""

    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return "&#xFFFD;" if len(digits) > 7 else f"&#{'x' if m[2] else ''}{digits};"

    return unescape(_LONG_NUMBER.sub(short, text)) if "&" in text else text


class Node:
    __slots__ = ("tag", "hidden", "start", "children")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1):
        self.tag, self.hidden, self.start, self.children = tag, hidden, start, []


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): resolved((m[2] or "").strip("\"'")) for m in reversed(list(_ATTRIBUTE.finditer(text)))}


def _element(tag: str, text: str) -> Node:
    hidden, start = tag in HIDDEN, 1
    if text and ("=" in text or "hidden" in text.lower()):
        found = _attributes(text)
        hidden = hidden or "hidden" in found or bool(_INVISIBLE.search(found.get("style", "")))
        hidden = hidden or (tag == "input" and found.get("type", "").lower() == "hidden")
        if tag == "ol" and re.fullmatch(r"-?\d{1,9}", found.get("start", "")):
            start = int(found["start"])
    return Node(tag, hidden, start)


def parse(html: str) -> Node:
    """The tree of a page; its text nodes are strings with entities resolved."""
    root = Node("html")
    stack, at = [root], 0
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            places[stack.pop().tag].pop()

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close_first(names: set[str], scope: set[str]) -> None:
        """Closes the outermost open element of these names inside the nearest scope."""
        within, found = last(scope), len(stack)
        for n in names:
            if places.get(n) and (i := bisect_right(places[n], within)) < len(places[n]):
                found = min(found, places[n][i])
        close(found)

    size = len(html)
    while at < size:
        m = _TOKEN.match(html, at)
        at, token = m.end(), m[0]
        tag = m[2] or m[5]
        if tag is None:
            if token[0] != "<" or token == "<":
                if stack[-1].tag == "head" and not token.isspace():
                    close(len(stack) - 1)
                stack[-1].children.append(resolved(token))
            continue
        tag, ends, rest = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ends:
            if tag == "p" and not places.get("p"):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag != "html" and places.get(tag):
                i = places[tag][-1]
                if tag in BLOCKS or i > last(("td", "th", "table")):  # an inline end tag does not reach out of a cell
                    close(i)
            continue
        if tag == "html":
            continue
        if tag in IMPLIED:
            close_first(*IMPLIED[tag])
        if tag in BLOCKS and places.get("p"):
            close_first({"p"}, {"td", "th", "table", "button", "object"})
        if stack[-1].tag == "head" and tag not in HEAD:
            close(len(stack) - 1)
        node = _element(tag, rest)
        node.hidden = node.hidden or (tag in ("desc", "metadata") and bool(places.get("svg")))
        stack[-1].children.append(node)
        if tag in RAW:
            end = _ENDS[tag].search(html, at)
            if not node.hidden:
                node.children.append(resolved(html[at : end.start() if end else size]))
            at = end.end() if end else size
        elif tag not in VOID and not rest.endswith("/") or tag in BLOCKS and tag not in VOID:
            places[tag].append(len(stack))
            stack.append(node)
    return root


class _Page:
    """Lines of text under way: the open line, and the gap that the next text needs."""

    __slots__ = ("lines", "line", "space", "gap", "bullet", "lists", "pre", "rows")

    def __init__(self):
        self.lines, self.line, self.space, self.gap = [], [], False, 0
        self.bullet, self.lists, self.pre, self.rows = "", [], 0, None

    def close_line(self, gap: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line, self.gap = [], 0
        self.space = False
        self.gap = max(self.gap, gap)

    def put(self, text: str) -> None:
        if not self.line:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap, depth = 0, min(INDENT, max(0, len(self.lists) - 1))
            self.line.append("  " * depth + (self.bullet or ("  " if self.lists else "")))
            self.bullet = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def text(self, text: str) -> None:
        if self.pre:
            for n, line in enumerate(text.split("\n")):
                if n:
                    if not self.line:
                        self.put("")
                    self.close_line(1)
                if line:
                    self.put(line)
            return
        flat = _SPACE.sub(" ", text)
        words = flat.strip(" ")
        if not words:
            self.space = self.space or bool(flat and self.line)
            return
        self.space = self.space or (flat[0] == " " and bool(self.line))
        self.put(words)
        self.space = flat[-1] == " "

    def done(self) -> list[str]:
        self.close_line(0)
        return self.lines


def _aligned(rows: list[list[list[str]]]) -> Iterator[str]:
    """Rows of cells (each a list of lines) as lines with two spaces between columns."""
    widths: dict[int, int] = {}
    for row in rows:
        for i, cell in enumerate(row):
            widths[i] = max(widths.get(i, 0), *(n for n in map(len, cell) if n <= WIDE), 0)
    for row in rows:
        high = max(map(len, row), default=0)
        size = sum(len(line) for cell in row for line in cell)
        if high * sum(widths[i] + 2 for i in range(len(row))) > PADDING * (size + 4 * len(row) + 16):
            yield from (line for cell in row for line in cell)
            continue
        for n in range(high):
            parts = []
            for i, cell in enumerate(row):
                line = cell[n] if n < len(cell) else ""
                if len(line) <= WIDE:
                    parts.append(line.ljust(widths[i]))
                    continue
                if any(p.strip(" ") for p in parts):
                    yield "  ".join(parts).rstrip(" ")
                yield line
                parts = []
            if any(p.strip(" ") for p in parts):
                yield "  ".join(parts).rstrip(" ")


def render(root: Node) -> str:
    """All visible text of a tree."""
    pages, cells, todo = [_Page()], [], [(root, False)]
    while todo:
        node, leaving = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            page.text(node)
            continue
        tag = node.tag
        if not leaving:
            if node.hidden:
                if tag in BLOCKS:
                    page.close_line(1)
                continue
            if tag == "br":
                if not page.line and not page.pre:
                    page.gap = max(page.gap, 2 if page.lines else 0)
                page.close_line(1)
                continue
            if tag == "table":
                page.close_line(2)
                page.rows = [page.rows]  # what an outer table has so far, then this one's rows
            elif tag == "tr" and page.rows is not None:
                page.rows.append([])
            elif tag in ("td", "th") and page.rows is not None and len(pages) <= NESTED:
                if len(page.rows) == 1:
                    page.rows.append([])
                pages.append(_Page())
                cells.append(node)
            elif tag in ("td", "th"):
                page.close_line(1)
            elif tag in ("ul", "ol", "menu", "dir"):
                page.close_line(2 if not page.lists else 1)
                page.lists.append([tag == "ol", node.start])
            elif tag == "li":
                page.close_line(1)
                if page.lists and page.lists[-1][0]:
                    page.bullet = f"{page.lists[-1][1]}. "
                    page.lists[-1][1] += 1
                else:
                    page.bullet = "- "
            elif tag in BLOCKS:
                page.close_line(2 if tag in PARAGRAPHS else 1)
                page.pre += tag == "pre"
            todo.append((node, True))
            todo.extend((child, False) for child in reversed(node.children))
            continue
        if cells and cells[-1] is node:
            cells.pop()
            cell = pages.pop().done()
            pages[-1].rows[-1].append(cell)
        elif tag in ("td", "th"):
            page.close_line(1)
        elif tag == "table":
            rows, page.rows = page.rows[1:], page.rows[0]
            page.close_line(2)
            for line in _aligned(rows):
                if line:
                    page.put(line)
                    page.close_line(1)
            page.close_line(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.lists.pop()
            page.close_line(2 if not page.lists else 1)
            page.bullet = ""
        elif tag in BLOCKS:
            page.close_line(2 if tag in PARAGRAPHS else 1)
            page.pre -= tag == "pre"
    return "\n".join(pages[0].done())


def visible_text(html: str | None) -> str:
    return render(parse(html)) if html else ""


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [visible_text(html.as_py()) for html in batch.column("html")]
        lines = [t.count("\n") + 1 if t else 0 for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], ["page_id", "text", "n_lines"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, text (all visible text, laid out) and n_lines of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_rendered, f"page_id {kind}, text string, n_lines long")
