"""HTML extraction by layout-aware rendering.

Pages are parsed into a tree, with the tags that HTML leaves out implied; the tree is walked with the visibility rules of a
browser, and all visible text is put out as lines: blocks are set apart, list items have markers and indentation, and the
cells of a table stand in aligned columns.  Formulas (MathML) run on in their line, rows of a matrix and formulas of their own have
lines; in drawings (SVG) each label is a line, and what a foreignObject holds is rendered as the page.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Fixed values of HTML: element kinds by their rendering and their implied end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas datalist noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div section article main aside header footer nav address li dt dd form figcaption details summary legend tr td th caption thead tbody tfoot center option optgroup select".split()
)
CLOSES_P = (BLOCK - frozenset("td th tr thead tbody tfoot caption option optgroup select html body".split()))
#: Tag -> the open tags that it ends, and those that it does not look past.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table"}),
    "th": ({"td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Start tags that end a formula or drawing that was not closed.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Elements of drawings that are rendered, outside of labels and in them; shapes, definitions and descriptions show no text.
DRAWN = {"svg": frozenset("svg g a switch text foreignobject".split()), "label": frozenset("tspan textpath a".split())}
#: Elements of formulas that are not shown, those that show their first child, and those whose children stand apart.
UNSHOWN = frozenset("annotation annotation-xml mphantom".split())
FIRST = frozenset("semantics maction".split())
APART = frozenset("mfrac mroot munder mover munderover mtr mlabeledtr mtd".split())
#: Elements of formulas and drawings whose children are those of a page, and those that no end tag of a page looks past.
PAGES = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
FENCE = frozenset(("foreignobject", "mtext"))
# Fixed values of HTML: the widest spans that count.
SPANS = {"colspan": 1000, "rowspan": 65534}
#: Lines of a cell are broken at spaces beyond this width, so that a long paragraph does not widen all rows; nor are lines
#: indented further.
WIDEST = 200
_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([a-z-]+)")
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*([a-z]+)")
_INTEGER = re.compile(r"[\t\n\f\r ]*([+-]?[0-9]{1,9})")
_MARKED = re.compile(r"<!\[(?!CDATA\[)[^>]*>")


class Node:
    """An element; ``kind`` is "math", "svg", "label" (in an SVG text) or "" for a page's own, ``inner`` that of its children."""

    __slots__ = ("attrs", "children", "inner", "kind", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None], around: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []
        self.kind = around or (tag if tag in ("svg", "math") else "")
        self.inner = "" if tag in PAGES.get(self.kind, ()) else "label" if (self.kind, tag) == ("svg", "text") else self.kind

    def removed(self) -> bool:
        """Whether neither the element nor anything in it is rendered."""
        if self.kind in DRAWN and (self.tag not in DRAWN[self.kind] or self.attrs.get("display") == "none"):
            return True
        if self.tag in HIDDEN or (self.kind == "math" and self.tag in UNSHOWN):
            return True
        display = _DISPLAY.findall((self.attrs.get("style") or "").lower())
        if display:
            return display[-1] == "none"
        return "hidden" in self.attrs or (self.tag == "dialog" and "open" not in self.attrs)

    def visible(self, around: bool) -> bool:
        """Whether own text is shown; unlike removal, an element in a hidden one can be shown again."""
        said = _VISIBILITY.findall((self.attrs.get("style") or "").lower()) or [self.attrs.get("visibility") if self.kind in DRAWN else None]
        return {"visible": True, "hidden": False, "collapse": False}.get(said[-1], around)

    def number(self, name: str, default: int) -> int:
        """An attribute as HTML reads integers; what is no number, or not a short one, is the default."""
        found = _INTEGER.match(self.attrs.get(name) or "")
        return int(found[1]) if found else default

    def span(self, name: str) -> int:
        n = self.number(name, 1)
        return min(n, SPANS[name]) if n > 0 or (name == "rowspan" and n == 0) else 1

    def lined(self) -> bool:
        """Whether an element of a formula or drawing has lines of its own."""
        if self.kind == "math":
            return self.tag in ("mtr", "mlabeledtr") or (self.tag == "math" and self.attrs.get("display") == "block")
        return self.tag in ("text", "foreignobject") or (self.tag == "tspan" and not self.attrs.keys().isdisjoint(("x", "y")))

    def shown(self) -> list[Node | str]:
        """The children that are rendered where the element is."""
        if self.inner == "svg":
            nodes = [c for c in self.children if isinstance(c, Node)]
            if self.tag == "switch":
                free = [c for c in nodes if c.attrs.keys().isdisjoint(("systemlanguage", "requiredextensions"))]
                return (free or nodes)[:1]
            return nodes
        if self.kind == "math" and self.tag in FIRST:
            return [c for c in self.children if isinstance(c, Node)][:1]
        if self.kind == "math" and self.tag in APART:
            return [x for c in self.children for x in (" ", c)] + [" "]
        if self.tag == "details" and "open" not in self.attrs:
            return [c for c in self.children if isinstance(c, Node) and c.tag == "summary"][:1]
        return self.children


class Tree(HTMLParser):
    """Builds the tree; tags that may be left out are opened and closed where the next tag implies it.

    What no ``>`` ends is text, and is not searched again for one; open elements are found by the places of each tag.  So the
    time for a page grows with its length, however broken it is.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # where each tag is open, ascending
        self.unended: set[str] = set()  # ends that do not come any more

    def _cut(self, at: int) -> None:
        for node in reversed(self.open[at:]):
            self.places[node.tag].pop()
        del self.open[at:]

    def _last(self, tags) -> int:
        """The innermost place where one of the tags is open, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _end(self, tags: set[str], walls: set[str]) -> None:
        """Closes from the outermost open element of ``tags`` that no wall hides."""
        own = [self.places[t] for t in tags if self.places.get(t)]
        if not own:
            return
        wall = max(self._last(walls), self._last(FENCE))
        inside = [p[k] for p in own if (k := bisect_right(p, wall)) < len(p)]
        if inside:
            self._cut(min(inside))

    def _parsed(self, i: int, end: str, parse: Callable[[int], int]) -> int:
        """The place after a piece of markup, or after the text that it is where nothing ends it."""
        for mark in (">", end):
            if mark not in self.unended and self.rawdata.find(mark, i + 1) < 0:
                self.unended.add(mark)
        k = -1 if self.unended & {">", end} else parse(i)
        if k < 0:
            k = 0 if ">" in self.unended else self.rawdata.find(">", i + 1) + 1
            k = k or self.rawdata.find("<", i + 1)
            k = len(self.rawdata) if k < 0 else k
            self.handle_data(self.rawdata[i:k] if self.cdata_elem else unescape(self.rawdata[i:k]))
        return k

    def parse_starttag(self, i: int) -> int:
        return self._parsed(i, ">", super().parse_starttag)

    def parse_endtag(self, i: int) -> int:
        return self._parsed(i, ">", super().parse_endtag)

    def parse_pi(self, i: int) -> int:
        return self._parsed(i, ">", super().parse_pi)

    def parse_comment(self, i: int, report: bool = True) -> int:
        return self._parsed(i, "--", super().parse_comment)

    def _push(self, tag: str, attrs: dict[str, str | None]) -> None:
        node = Node(tag, attrs, self.open[-1].inner)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places[tag].append(len(self.open))
            self.open.append(node)

    def _leave(self) -> None:
        """Closes the formula or drawing that is open, up to what holds parts of a page."""
        while self.open[-1].inner:
            self._cut(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BREAKS_OUT or (tag == "font" and any(k in ("color", "face", "size") for k, _ in attrs)):
            self._leave()
        if tag in ("html", "body"):
            if tag == "body":
                self._end({"head"}, set())
            self.open[-1].attrs.update({k: v for k, v in attrs if k not in self.open[-1].attrs}) if tag == "html" else self._push(tag, dict(attrs))
            return
        if self.open[-1].tag == "head" and (tag in BLOCK or tag in ("a", "b", "i", "span", "em", "strong", "br", "img", "svg", "math")):
            self._cut(len(self.open) - 1)
        if tag in CLOSES_P:
            self._end({"p"}, {"table", "td", "th", "button", "caption", "object"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", {})
        self._push(tag, dict(attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open[-1].kind and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("p", "br"):
            self._leave()
        if tag == "p" and not self.places["p"]:
            self._push("p", {})
        if tag in VOID:
            if tag == "br":
                self._push("br", {})
            return
        at = self._last((tag,))
        if not at:
            return
        if tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html") and self._last(("table", "td", "th")) > at:
            return
        if tag in ("svg", "math") or self._last(FENCE) <= at:
            self._cut(at)

    def parse_html_declaration(self, i: int) -> int:
        """CDATA is text in formulas and drawings, and a comment elsewhere."""
        if not self.rawdata.startswith("<![CDATA[", i):
            return self._parsed(i, ">", super().parse_html_declaration)
        if not self.open[-1].kind:
            return self._parsed(i, ">", lambda at: self.rawdata.find(">", at) + 1 or -1)
        end = self.rawdata.find("]]>", i + 9)
        self.handle_data(self.rawdata[i + 9 : end if end >= 0 else len(self.rawdata)])
        return end + 3 if end >= 0 else len(self.rawdata)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)


class Lines:
    """Text in the making: collapses white space, and keeps breaks back until more text follows."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.breaks, self.space, self.indent, self.marker = 0, False, "", ""

    def block(self, n: int) -> None:
        if self.line:
            self.done.append("".join(self.line).rstrip())
            self.line = []
            self.breaks = n
        elif self.done:
            self.breaks = max(self.breaks, n)
        self.space = False

    def _begin(self) -> None:
        if not self.line:
            self.done += [""] * (self.breaks - 1)
            self.breaks = 0
            self.line.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker = ""

    def text(self, data: str) -> None:
        words = data.split()
        if not words:
            self.space = True
            return
        begun = bool(self.line)
        self._begin()
        if begun and (self.space or data[0].isspace()):
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = data[-1].isspace()

    def verbatim(self, data: str) -> None:
        for i, part in enumerate(data.split("\n")):
            if i:
                self._begin()
                self.block(1)
            if part.strip():
                self._begin()
                self.line.append(part)

    def result(self) -> list[str]:
        self.block(1)
        return self.done


def _width(text: str) -> int:
    """Columns that a line takes on a screen: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 1 for c in text)


def _wrapped(line: str) -> list[str]:
    """A line broken at spaces so that parts are no wider than WIDEST; a wider word is a part of its own."""
    if _width(line) <= WIDEST:
        return [line]
    out, own = [], 0
    for word in line.split(" "):
        n = _width(word)
        if out and own + 1 + n <= WIDEST:
            out[-1] += " " + word
            own += 1 + n
        else:
            out.append(word)
            own = n
    return out


@dataclass
class Cell:
    lines: list[str]
    columns: int = 1
    rows: int = 1
    at: int = 0


@dataclass
class Rows:
    """The rows of a table; those of its foot come last, wherever it stands."""

    body: list[list[Cell]] = field(default_factory=list)
    foot: list[list[Cell]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.to = self.body

    def ordered(self) -> list[list[Cell]]:
        return self.body + self.foot


def _columns(rows: list[list[Cell]]) -> list[str]:
    """The rows of a table as lines of aligned columns; cells that span rows or columns leave what they span free."""
    taken: list[tuple[int, int, int]] = []  # columns from, up to, and the row up to which a cell from above has them
    for y, row in enumerate(rows):
        x = k = 0
        taken = sorted(t for t in taken if t[2] > y)
        below = []
        for cell in row:
            while k < len(taken) and taken[k][0] <= x:
                x = max(x, taken[k][1])
                k += 1
            cell.at = x
            last = y + cell.rows if cell.rows else len(rows)
            if last > y + 1:
                below.append((x, x + cell.columns, last))
            x += cell.columns
        taken += below
    starts = sorted({c.at for row in rows for c in row})  # a column where no cell begins takes no room
    place = {x: i for i, x in enumerate(starts)}
    widths = [0] * len(starts)
    for row in rows:
        for cell in row:
            cell.lines = [part for line in cell.lines for part in _wrapped(line)]
            cell.columns = bisect_left(starts, cell.at + cell.columns) - place[cell.at]
            cell.at = place[cell.at]
            widths[cell.at] = max(widths[cell.at], max(map(_width, cell.lines), default=0))
    out = []
    for row in rows:
        for k in range(max((len(c.lines) for c in row), default=0)):
            parts, x, any_text = [], 0, False
            for cell in row:
                parts += [" " * w for w in widths[x : cell.at]]
                x = cell.at + cell.columns
                line = cell.lines[k] if k < len(cell.lines) else ""
                any_text |= bool(line)
                parts += [line + " " * (widths[cell.at] - _width(line)), *(" " * w for w in widths[cell.at + 1 : x])]
            out.append(" | ".join(parts).rstrip(" " if any_text else " |"))
    return out


def render(html: str | None) -> str:
    """All visible text of a page; of no page the empty text."""
    if not html:
        return ""
    tree = Tree()
    end = html.rfind(">") + 1
    tree.feed(_MARKED.sub("", html[:end]) + html[end:])
    tree.close()
    writers, tables, lists, outer, verbatim = [Lines()], [], [], [], 0
    work: list[tuple[bool, bool, Node | str]] = [(True, True, tree.root)]
    while work:
        enter, seen, node = work.pop()
        out = writers[-1]
        if isinstance(node, str):
            # loose text between the rows of a table belongs before it; white space there is nothing
            if seen:
                out.verbatim(node) if verbatim else out.text(node)
            continue
        tag = node.tag
        if enter:
            if node.removed():
                continue
            seen = node.visible(seen)
            if tag == "br":
                out._begin()
                out.block(1)
                continue
            if tag in BLOCK:
                out.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol"):
                down = tag == "ol" and "reversed" in node.attrs
                items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if down else 1
                step = -1 if down else 1
                lists.append([tag, node.number("start", items) - step, out.indent, step])
            elif tag == "li":
                kind, number, indent, step = lists[-1] if lists else ["ul", 0, out.indent, 1]
                number = node.number("value", number + step) if kind == "ol" else 0
                mark = ("- " if kind == "ul" else f"{number}. ") if seen else ""
                if lists:
                    lists[-1][1] = number
                out.indent, out.marker = (indent + " " * len(mark))[:WIDEST], mark
            elif tag == "dd":
                outer.append(out.indent)
                out.indent = (out.indent + "  ")[:WIDEST]
            elif tag == "pre":
                verbatim += 1
            elif tag == "table":
                tables.append(Rows())
            elif tag == "tfoot" and tables:
                tables[-1].to = tables[-1].foot
            elif tag == "tr" and tables:
                tables[-1].to.append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1].to:
                    tables[-1].to.append([])
                writers.append(Lines())
                lists.append(["ul", 0, "", 1])
            if node.kind and node.lined():
                out.block(1)
            work.append((False, seen, node))
            work += [(True, seen, c) for c in reversed(node.shown())]
            continue
        if tag in ("td", "th") and tables:
            lists.pop()
            tables[-1].to[-1].append(Cell(writers.pop().result(), node.span("colspan"), node.span("rowspan")))
            continue
        if tag == "table":
            for line in _columns(tables.pop().ordered()):
                out._begin()
                out.line.append(line)
                out.block(1)
        elif tag == "tfoot" and tables:
            tables[-1].to = tables[-1].body
        elif tag in ("ul", "ol"):
            out.indent = lists.pop()[2]
        elif tag == "li":
            out.indent, out.marker = lists[-1][2] if lists else "", ""
        elif tag == "dd":
            out.indent = outer.pop()
        elif tag == "pre":
            verbatim -= 1
        if node.kind and node.lined() and tag != "tspan":
            out.block(1)
        if tag in BLOCK:
            out.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
    return "\n".join(writers[0].result())


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text): the visible text of every page, a null or empty page as the empty text.

    Any input gives a result: what is not closed is closed at the end, what does not fit is text.  Identifiers may be null or
    repeat; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([render(h.as_py()) for h in b.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), texts], ["page_id", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, text string")


def op4_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
