"""Visible text of HTML pages, laid out as blocks, lists and aligned tables."""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from rosterlake.llm.common import arrow_map, ship

# Fixed values of HTML: elements by what they do to layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title meta link iframe object canvas audio video datalist".split())
#: What svg and math don't show of their content, and what ends them where it isn't inside one of ``_HTML_AGAIN``.
FOREIGN_HIDDEN = {
    "svg": frozenset("desc defs symbol metadata clippath mask pattern marker filter lineargradient radialgradient".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
_ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p"
    " pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_HTML_AGAIN = {"foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
#: Parts of a formula that stand apart: what such an element holds.
_APART = frozenset("mfrac mtable mtr mtd munder mover munderover".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
BLOCKS = PARAGRAPHS | frozenset(
    "address article aside body center dd details dialog div dt fieldset figcaption footer form header hr html legend li main"
    " menu nav optgroup option section summary tr td th thead tbody tfoot caption".split()
)
#: Elements that a start tag closes, if open, up to one of the elements behind them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: What a p can't hold, so that its start ends an open p.
_ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup"}
_UNSEEN_STYLE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
#: Unlike ``display``, which takes a whole element away, visibility is inherited, and a part may be shown again.
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
#: A tag that the end of the page cuts off is no text.
_CUT_TAG = re.compile(r"<[A-Za-z/][^<>]*\Z")
_SPACES = re.compile(r"[ \t\n\r\f]+")


def _span(given: str | None, most: int) -> int:
    """A number of columns or rows as browsers read it: 1 where it says nothing useful."""
    digits = re.match(r"\s*(\d{1,9})", given or "")
    return min(max(int(digits[1]), 1), most) if digits else 1


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Flow:
    """Lines of one flow of blocks: the page, a list entry's or a table cell's."""

    def __init__(self, indent: str = ""):
        self.lines: list[str] = []
        self.indent, self.line, self.gap, self.space = indent, "", 0, False
        self.bullet = ""

    def end_line(self, blank: bool = False) -> None:
        if self.line:
            self.lines.append(self.line.rstrip())
        self.line, self.space = "", False
        if blank and self.lines:
            self.gap = 1

    def _open(self) -> None:
        if not self.line:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.line = self.indent + self.bullet
            if self.bullet:
                self.indent += " " * len(self.bullet)
                self.bullet = ""

    def words(self, text: str) -> None:
        flat = _SPACES.sub(" ", text)
        if flat.strip(" ") == "":
            self.space |= bool(flat) and bool(self.line)
            return
        fresh = not self.line
        self._open()
        if not fresh and (self.space or flat[0] == " ") and not self.line.endswith(" "):
            self.line += " "
        self.line += flat.strip(" ")
        self.space = flat[-1] == " "

    def raw(self, text: str) -> None:
        for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                if not self.line:
                    self.lines.append("")
                self.end_line()
            if part:
                self._open()
                self.line += part

    def block(self, lines: list[str]) -> None:
        self.end_line(True)
        if lines:
            self._open()
            pad, self.line = self.line, ""
            self.lines += [(pad if i == 0 else self.indent) + x for i, x in enumerate(lines)]
            self.gap = 1

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Cell:
    """Lines of a table cell and how many columns and rows it spans."""

    __slots__ = ("lines", "columns", "rows")

    def __init__(self, lines: list[str], columns: int = 1, rows: int = 1):
        self.lines, self.columns, self.rows = lines, columns, rows


#: Widest column that cells are padded to; and what a row may take in padding: so many characters, and so many times its text.
WIDEST, FREE_PADDING, MOST_PADDING = 120, 2000, 8


def _placed(rows: list[list[_Cell]]) -> list[list[tuple[int, _Cell]]]:
    """The column that each cell begins in: the first that no cell to the left or from above takes."""
    out, above = [], []  # above: (first column, column behind, rows left), in order
    for row in rows:
        taken, column, here = iter([*above, (1 << 30, 1 << 30, 0)]), 0, []
        first, behind, _ = next(taken)
        down = []
        for cell in row:
            while column + 1 > first:
                column = max(column, behind)
                first, behind, _ = next(taken)
            here.append((column, cell))
            if cell.rows > 1:
                down.append((column, column + cell.columns, cell.rows - 1))
            column += cell.columns
        out.append(here)
        above = _merged(sorted([(f, b, n - 1) for f, b, n in above if n > 1] + down))
    return out


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbours that end with the same row as one."""
    out: list[tuple[int, int, int]] = []
    for f, b, n in spans:
        if out and out[-1][1] == f and out[-1][2] == n:
            f = out.pop()[0]
        out.append((f, b, n))
    return out


def _table(rows: list[list[_Cell]]) -> list[str]:
    """Cells side by side, two blanks apart, each at the place of its column.

    Columns are as wide as their widest line, ``WIDEST`` at most; longer lines push what
    follows in their row aside. A cell that spans columns widens the last of them if need
    be. A row that would take far more padding than text has its cells one below
    the other instead, so that the text of a page stays in proportion to the page.
    """
    placed = [here for here in _placed(rows) if any(c.lines for _, c in here)]
    starts = sorted({column for here in placed for column, _ in here})
    place = {column: k for k, column in enumerate(starts)}
    widths, wide = [0] * len(starts), []
    spans = [[(place[column], bisect.bisect_left(starts, column + cell.columns), cell) for column, cell in here] for here in placed]
    for here in spans:
        for k, behind, cell in here:
            width = min(WIDEST, max(map(_width, cell.lines), default=0))
            if behind - k > 1:
                wide.append((k, behind, width))
            else:
                widths[k] = max(widths[k], width)
    for k, behind, width in wide:
        widths[behind - 1] = max(widths[behind - 1], width - sum(widths[k : behind - 1]) - 2 * (behind - k - 1))
    offsets = [0, *itertools.accumulate(w + 2 for w in widths)]
    out = []
    for here in spans:
        full = [(k, cell) for k, _, cell in here if cell.lines]
        height = max(len(cell.lines) for _, cell in full)
        if height * offsets[full[-1][0]] > FREE_PADDING + MOST_PADDING * sum(len(x) for _, cell in full for x in cell.lines):
            out += [x for _, cell in full for x in cell.lines]
            continue
        for n in range(height):
            line, at = [], 0
            for k, cell in full:
                if n < len(cell.lines) and cell.lines[n]:
                    gap = max(offsets[k] - at, 2 if line else 0)
                    line.append(" " * gap + cell.lines[n])
                    at += gap + _width(cell.lines[n])
            out.append("".join(line).rstrip())
    return out


class _Renderer(HTMLParser):
    """Keeps the open elements as a stack, so that depth costs no recursion."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: (tag, unseen, preformatted); sums over the stack beside it.
        self.open: list[tuple[str, int, bool]] = []
        #: Beside the stack: whether an element is laid out, and how many hidden visibilities hold outside it.
        self.beside: list[tuple[bool, int]] = []
        self.unseen = self.pre = self.veils = 0
        self.count: dict[str, int] = {}
        self.flows = [_Flow()]
        self.tables: list[list[list[_Cell]]] = []
        #: Columns and rows that the open cells span.
        self.spans: list[tuple[int, int]] = []
        self.numbers: list[int | None] = []
        self.in_cell: list[bool] = []
        #: Open selects that show one option: whether hidden, the text of the selected one and of the first; and the one being read.
        self.shown: list[list] = []
        self.picking: list[str] | None = None

    @property
    def flow(self) -> _Flow:
        return self.flows[-1]

    def _foreign(self) -> str | None:
        """svg or math, if the open place is of their kind and not HTML inside them."""
        if not self.count.get("svg") and not self.count.get("math"):
            return None
        return next((n if n in FOREIGN_HIDDEN else None for n, _, _ in reversed(self.open) if n in FOREIGN_HIDDEN or n == "foreignobject"), None)

    def _apart(self) -> None:
        self.flow.space |= bool(self.flow.line)

    def _choice(self, tag: str, given: dict, hidden: bool) -> bool:
        """Whether a part of a select is out of sight; a list of options shows all, another select the one selected or else the first."""
        label = given.get("label") or ""
        if tag == "select":
            size = given.get("size") or ""
            if "multiple" in given or re.fullmatch(r"\d{1,9}", size) and int(size) > 1:
                return hidden
            self.shown.append([hidden, None, None])
            return True
        if tag == "option" and self._in_drop_down():
            place = 1 if "selected" in given else 2 if self.shown[-1][2] is None and "disabled" not in given else 0
            if place and not hidden:
                self.picking = self.shown[-1][place] = [label] if label else []
                self.picking = None if label else self.picking
        elif not self.unseen and not hidden and label and self.count.get("select"):
            self.flow.end_line()
            self.flow.words(label)
            return tag == "option"
        return hidden

    def _in_drop_down(self) -> bool:
        return next((unseen for n, unseen, _ in reversed(self.open) if n == "select"), False) and bool(self.shown)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_FOREIGN and self._foreign():
            self._close({"svg", "math"}, _HTML_AGAIN, every=True)
        if tag in _ENDS_P and self.count.get("p"):
            self._close({"p"}, {"td", "th", "li", "table", "button"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag], every=True)
        if tag in ("td", "th") and self.tables and not self._inside("tr", "table"):
            self.handle_starttag("tr", [])
        given = dict(attrs)
        unseen = (
            tag in HIDDEN or "hidden" in given and given["hidden"] != "until-found"
            or tag == "input" or bool(_UNSEEN_STYLE.search(given.get("style") or ""))
            or tag == "dialog" and "open" not in given
        )
        foreign = self._foreign()
        if foreign:
            unseen |= tag in FOREIGN_HIDDEN[foreign] or (given.get("display") or "").strip() == "none"
            unseen |= foreign == "svg" and (given.get("visibility") or "").strip() in ("hidden", "collapse")
        if tag in ("select", "option", "optgroup"):
            unseen = self._choice(tag, given, unseen)
        veiled = [x.lower() != "visible" for x in _VISIBILITY.findall(given.get("style") or "")][-1:]
        weight = int(unseen) + (1 if veiled == [True] else -self.veils if veiled == [False] and tag != "select" else 0)
        seen = not self.unseen + weight
        if seen and foreign and (self.open[-1][0] in _APART or tag == "text" or tag == "tspan" and given.keys() & {"x", "y", "dx", "dy"}):
            self._apart()
        if tag in VOID:
            if seen and tag == "br":
                if not self.flow.line and not self.pre:
                    self.flow.gap = 1 if self.flow.lines else 0
                self.flow.end_line()
            elif seen and tag == "hr":
                self.flow.end_line(True)
            elif seen and tag == "img" and (given.get("alt") or "").strip():
                self.flow.words(given["alt"])
            return
        self.open.append((tag, weight, tag in ("pre", "textarea")))
        self.beside.append((seen, self.veils))
        self.veils = self.veils + 1 if veiled == [True] else 0 if veiled == [False] else self.veils
        self.count[tag] = self.count.get(tag, 0) + 1
        self.unseen += weight
        self.pre += tag in ("pre", "textarea")
        if seen:
            self._enter(tag, given)

    def _enter(self, tag: str, given: dict) -> None:
        if tag == "table":
            self.flow.end_line(True)
            self.tables.append([])
            self.in_cell.append(False)
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.flows.append(_Flow())
            self.spans.append((_span(given.get("colspan"), 1000), _span(given.get("rowspan"), 65534)))
            self.in_cell[-1] = True
        elif tag in ("ul", "ol", "menu"):
            self.flow.end_line(blank=not self.numbers)
            start = given.get("start") or ""
            self.numbers.append((int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if tag == "ol" else None)
        elif tag == "li":
            self.flow.end_line()
            if self.numbers and self.numbers[-1] is not None:
                mark = f"{self.numbers[-1]}. "
                self.numbers[-1] += 1
            else:
                mark = "- "
            inner = _Flow(self.flow.indent)
            inner.bullet = mark
            self.flows.append(inner)
        elif tag == "dd":
            self.flow.end_line()
            self.flows.append(_Flow(self.flow.indent + "  "))
        elif tag == "blockquote":
            self.flow.end_line(True)
            self.flows.append(_Flow(self.flow.indent + "  "))
        elif tag in BLOCKS:
            self.flow.end_line(tag in PARAGRAPHS)

    def _leave(self, tag: str) -> None:
        if tag == "table" and self.tables:
            rows = self.tables.pop()
            self.in_cell.pop()
            self.flow.block(_table(rows))
        elif tag in ("td", "th") and self.tables and self.tables[-1] and self.in_cell[-1]:
            self.in_cell[-1] = False
            self.tables[-1][-1].append(_Cell(self.flows.pop().done(), *self.spans.pop()))
        elif tag in ("ul", "ol", "menu") and self.numbers:
            self.numbers.pop()
            self.flow.end_line(blank=not self.numbers)
        elif tag in ("li", "dd", "blockquote") and len(self.flows) > 1:
            lines = self.flows.pop().done()
            if lines:
                if self.flow.gap and self.flow.lines and self.flow.lines[-1]:
                    self.flow.lines.append("")
                self.flow.gap = 0
                self.flow.lines += lines
            if tag == "blockquote":
                self.flow.gap = 1
        elif tag == "text" and self._foreign() == "svg":
            self._apart()
        elif tag in BLOCKS:
            self.flow.end_line(tag in PARAGRAPHS)

    def _pop(self) -> None:
        tag, unseen, pre = self.open.pop()
        seen, self.veils = self.beside.pop()
        self.count[tag] -= 1
        self.unseen -= unseen
        self.pre -= pre
        if tag == "option":
            self.picking = None
        if seen:
            self._leave(tag)
        if tag == "select" and unseen and self.shown:
            choice = self.shown.pop()
            text = "".join(choice[1] if choice[1] is not None else choice[2] or ())
            if not choice[0] and not self.unseen and text.strip():
                self._apart()
                self.flow.words(text)
                self._apart()

    def _inside(self, tag: str, border: str) -> bool:
        for name, _, _ in reversed(self.open):
            if name in (tag, border):
                return name == tag
        return False

    def _close(self, tags: set[str], borders: set[str], every: bool = False) -> None:
        """Close the nearest open element of ``tags`` this side of a border; ``every``: all of them."""
        if not any(self.count.get(t) for t in tags):
            return
        depth = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in borders:
                break
            if self.open[k][0] in tags:
                depth = k
                if not every:
                    break
        while depth is not None and len(self.open) > depth:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and not self.count.get("p"):
            if not self.unseen:
                self.flow.end_line(True)
        elif self.count.get(tag):
            # An end tag doesn't reach out of the cell or table that it stands in.
            borders = {"td", "th", "table"} - {tag} if tag not in ("tr", "table", "thead", "tbody", "tfoot", "body", "html") else {"table"} - {tag}
            self._close({tag}, borders)

    def handle_data(self, data: str) -> None:
        if self.picking is not None:
            self.picking.append(data)
        if self.unseen or self.count.get("svg") and not self.count.get("text") and self._foreign() == "svg":
            return
        if self.tables and not self.in_cell[-1]:
            if not data.strip(" \t\n\r\f"):
                return
            # Text between cells stands before the table, as browsers place it.
        if self.pre:
            self.flow.raw(data)
        else:
            self.flow.words(data)

    def text(self) -> str:
        while self.open:
            self._pop()
        return "\n".join(self.flows[0].done())


def visible_text(html: str) -> str:
    """All visible text of a page; malformed markup is repaired as far as layout needs it."""
    page = _Renderer()
    page.feed(_CUT_TAG.sub("", html))
    page.close()
    return page.text()


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text of every row of ``pages``.

    Hidden are scripts, styles, the head and other elements that browsers don't display
    (noscript, template, datalist, and what stands in frames, objects, canvas, audio and
    video for readers that lack them), the ``hidden`` attribute, inline ``display: none`` and ``visibility: hidden``, closed dialogs,
    and comments. Blocks stand on lines of their own, paragraphs a blank line apart;
    list entries get bullets or numbers and are indented by depth; table cells are
    padded to their column's width, spans included, as far as padding stays in proportion; preformatted text keeps its blanks. Formulas give
    the text of their signs, without annotations; drawings that of their text elements
    (not what only a ``use`` draws); lists of options all options, other selects the one
    marked ``selected``, or else the first that isn't disabled. What is made visible inside a hidden
    visibility is shown.

    Null html gives a null text, empty html an empty one; repeated rows repeat; null
    ids stay; other columns aren't looked at. Row-local, no shuffle.
    """
    ship(pages.sparkSession)
    rows = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[html_col].cast("string").alias("html"))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [None if h is None else visible_text(h) for h in batch.column("html").to_pylist()]
        yield {"page_id": batch.column("page_id"), "text": pa.array(texts, pa.string())}

    return arrow_map(rows, step, "page_id bigint, text string")
