"""Visible text of HTML pages, laid out as a page would show it.

`tree_events` builds the tree of open elements from tag soup, with implied start and end
tags; `render` walks it and lays text out: block spacing, lists, preformatted text
and table cells in aligned columns.  Invisible subtrees are skipped.  Both work on a
stack, so nesting of any depth is fine, and take time in proportion to the page.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evledger.llm.common import arrow_map, as_bytes

# Names of HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript title textarea".split())
HIDDEN = frozenset(
    "script style template head title meta link base noscript iframe noembed noframes object audio video canvas svg"
    " math datalist select option optgroup area map param source track dialog textarea input".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset form menu".split())
BLOCKS = SPACED | frozenset(
    "html body address article aside center details dd div dt figcaption footer header hgroup legend li main nav"
    " search section summary caption tbody thead tfoot tr td th".split()
)
CLOSES_P = (BLOCKS - frozenset("html body tbody thead tfoot tr td th caption legend".split())) | {"plaintext"}
#: A start tag ends these open elements, up to the element that bounds the search.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ("html",)),
}
#: End tags do not reach through these.
SCOPES = frozenset("table td th caption html object template".split())
#: Start tags that mean something inside a table only.
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
IN_HEAD = frozenset("head html title meta link base script style noscript template".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")

Event = tuple[str, str, dict[str, str]]


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape("".join(values)))
    return found


def tree_events(page: str) -> Iterator[Event]:
    """``("open"|"text"|"close", name or text, attributes)`` of a well-formed tree."""
    stack: list[str] = []
    depths: dict[str, list[int]] = {}  # where each name is open, so searches need no walk

    def push(name: str) -> None:
        depths.setdefault(name, []).append(len(stack))
        stack.append(name)

    def pop_to(depth: int) -> Iterator[Event]:
        while len(stack) > depth:
            name = stack.pop()
            depths[name].pop()
            yield "close", name, {}

    def is_open(name: str) -> bool:
        return bool(depths.get(name))

    def edge(bounds: frozenset[str] | tuple[str, ...]) -> int:
        return max((depths[n][-1] for n in bounds if depths.get(n)), default=-1)

    def find(name: str, bounds: frozenset[str] | tuple[str, ...]) -> int:
        """Depth of the innermost open ``name`` within the bounds, or -1."""
        depth = depths[name][-1] if depths.get(name) else -1
        return depth if depth > edge(bounds) else -1

    def outermost(names: tuple[str, ...], bounds: tuple[str, ...]) -> int:
        """Depth of the outermost open one of ``names`` within the bounds, or -1."""
        if not any(map(is_open, names)):
            return -1
        limit = edge(bounds)
        found = [d[k] for n in names if (d := depths.get(n)) and (k := bisect_right(d, limit)) < len(d)]
        return min(found, default=-1)

    at = 0
    raw = ""
    size = len(page)
    while at < size:
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else size
            if stop > at:
                yield "text", page[at:stop], {}
            at, raw = stop, ""
            continue
        match = _TOKEN.search(page, at)
        stop = match.start() if match else size
        if stop > at:
            yield "text", page[at:stop], {}
        if not match:
            break
        at = match.end()
        if match[1] is None:
            if match[0].startswith("<![CDATA["):
                yield "text", match[0][9:].removesuffix("]]>"), {}
            continue
        name = match[1].lower()
        if match[0][1] == "/":
            if name == "br":
                yield "open", "br", {}
                yield "close", "br", {}
            elif name == "p" and find("p", SCOPES) < 0:
                yield from (("open", "p", {}), ("close", "p", {}))
            else:
                bounds = () if name == "table" else ("table",) if name in TABLE_PARTS else SCOPES
                depth = find(name, bounds)
                if depth >= 0:
                    yield from pop_to(depth)
            continue
        if name in TABLE_PARTS and not is_open("table"):
            continue
        if name in CLOSES_P and (depth := find("p", SCOPES)) >= 0:
            yield from pop_to(depth)
        if name in IMPLIED:
            names, bounds = IMPLIED[name]
            if (depth := outermost(names, bounds)) >= 0:
                yield from pop_to(depth)
        elif is_open("head") and name not in IN_HEAD and (depth := find("head", ("template",))) >= 0:
            yield from pop_to(depth)
        if name in ("td", "th") and find("tr", ("table",)) < 0:
            push("tr")
            yield "open", "tr", {}
        held = match[2]
        found = attributes(held) if held and ("=" in held or "hidden" in held.lower()) else {}
        yield "open", name, found
        if name in VOID or (held.rstrip().endswith("/") and (is_open("svg") or is_open("math"))):
            yield "close", name, {}
        else:
            push(name)
            raw = name if name in RAW else ""
    yield from pop_to(0)


def unseen(name: str, found: dict[str, str]) -> bool:
    """Visibility rules of an element and all below it."""
    return bool(
        name in HIDDEN
        or (found and ("hidden" in found or _UNSEEN.search(found.get("style", ""))))
    )


class _Flow:
    """Lines of a block context; white space collapses, margins do not add up."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # blank lines owed before the next text
        self.indents: list[str] = []
        self.mark = ""
        self.space = False

    def write(self, text: str) -> None:
        """Inline text with collapsing white space."""
        body = _SPACE.sub(" ", text)
        if body[:1] == " ":
            self.space = True
        word = body.strip(" ")
        if not word:
            return
        if not self.line:
            self._start()
        elif self.space:
            self.line.append(" ")
        self.line.append(word)
        self.space = body[-1] == " "

    def _start(self) -> None:
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        indent = "".join(self.indents)
        if self.mark:
            indent = indent[: len(indent) - len(self.mark)] + self.mark
            self.mark = ""
        self.line.append(indent)
        self.space = False

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, blank: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, int(blank))

    def verbatim(self, text: str) -> None:
        first, *others = text.split("\n")
        if first:
            if not self.line:
                self._start()
            self.line.append(first)
        for part in others:
            if not self.line:
                self._start()
            self.end_line()
            if part:
                self._start()
                self.line.append(part)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def _aligned(rows: list[list[str]]) -> list[str]:
    """Cells padded to the width of their column; cells with lines use several."""
    widths: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            wide = max(map(len, cell.split("\n")))
            if i == len(widths):
                widths.append(wide)
            else:
                widths[i] = max(widths[i], wide)
    out = []
    for row in rows:
        cells = [cell.split("\n") for cell in row]
        for k in range(max(map(len, cells), default=0)):
            line = [(c[k] if k < len(c) else "").ljust(w) for c, w in zip(cells, widths)]
            out.append(" | ".join(line).rstrip(" "))
    return out


def render(page: str) -> str:
    """All visible text of a page; an empty page gives an empty text."""
    flows = [_Flow()]
    tables: list[list[list[str]]] = []
    lists: list[int | None] = []
    opened: list[str] = []  # kinds of contexts that close tags have to undo
    skip = pre = 0
    for kind, name, found in tree_events(page):
        flow = flows[-1]
        if skip:
            skip += (kind == "open") - (kind == "close")
            continue
        if kind == "text":
            text = unescape(name) if "&" in name else name
            if pre:
                flow.verbatim(text)
            else:
                flow.write(text)
        elif kind == "open":
            if unseen(name, found):
                skip = 1
                continue
            opened.append(name)
            if name == "br":
                if not flow.line:
                    flow._start()
                flow.end_line()
            elif name == "img":
                flow.write(found.get("alt", ""))
            elif name == "table":
                flow.block(True)
                tables.append([])
            elif name == "tr" and tables:
                tables[-1].append([])
            elif name in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append(_Flow())
            elif name in BLOCKS:
                flow.block(name in SPACED and not (name in ("ul", "ol") and lists))
                if name in ("ul", "ol", "menu"):
                    start = found.get("start", "")
                    first = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
                    lists.append(first - 1 if name == "ol" else None)
                elif name == "li":
                    mark = "- "
                    if lists and lists[-1] is not None:
                        lists[-1] += 1
                        mark = f"{lists[-1]}. "
                    flow.indents.append(" " * len(mark))
                    flow.mark = mark
                elif name in ("blockquote", "dd"):
                    flow.indents.append("  ")
                elif name == "pre":
                    pre += 1
        else:
            opened.pop()
            if name == "table" and tables:
                rows = tables.pop()
                for line in _aligned([r for r in rows if any(r)]):
                    flow.verbatim(line)
                    flow.end_line()
                flow.block(True)
            elif name in ("td", "th") and tables and len(flows) > 1:
                flows.pop()
                tables[-1][-1].append(flow.text())
            elif name in BLOCKS and name not in ("tr", "td", "th"):
                if name in ("ul", "ol", "menu") and lists:
                    lists.pop()
                elif name in ("li", "blockquote", "dd") and flow.indents:
                    flow.end_line()
                    flow.indents.pop()
                    flow.mark = ""
                elif name == "pre":
                    pre -= 1
                flow.block(name in SPACED and not (name in ("ul", "ol") and lists))
    return flows[0].text()


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, text, n_lines)`` per row; a null page has an empty text."""

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        texts = [render(b.decode("utf-8", "replace")) for b in as_bytes(batch.column("html"))]
        lines = [text.count("\n") + 1 if text else 0 for text in texts]
        return {"page_id": batch.column("page_id"), "text": texts, "n_lines": lines}

    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), "html")
    return arrow_map(kept, "page_id long, text string, n_lines long", each, sized_by="html")
