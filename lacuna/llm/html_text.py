"""Layout-aware rendering of HTML to text.

A tree builder reads tags and text in order and keeps the stack of open elements, with the implied
tags of HTML: a block closes an open paragraph, an item the item before it, a row its cells, a table
part its rows, and an end tag what it encloses. A layout engine takes the builder's events and writes
the text that a reader would see: blocks on lines of their own, blank lines around paragraphs and
headings, list items with bullets or numbers under an indent, preformatted text as it is, and tables
with cells aligned in columns (a cell's own text is laid out first, so tables nest).

Not visible: scripts, styles, templates, the head, comments, closed dialogs, details that aren't open but
for their summary, media and objects with their fallback text, titles, descriptions and definitions of
drawings, annotations of formulas, brackets of ruby text, elements with the attribute ``hidden`` or ``display: none``, and text
whose nearest element with a ``visibility`` says hidden. Styles are those of the attribute and, below it, of the page's
style elements so far, with ``!important`` above both; read are selectors of a tag, classes and an id, alone or under
others of the kind (``div p``), and media rules that hold on any wide screen.

The builder keeps no tree and doesn't recurse, so depth costs memory only; a page is read in one pass. Where an open
element stands, where the nearest stop of an end tag, which columns cells of rows above still take and which rules may
hold for an element are looked up, not searched for, so stray tags, wide spans and long sheets don't make a page slow.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship

#: Fixed sets of elements, by their roles in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("script style title template head rp iframe noembed noframes noscript datalist object audio video canvas defs desc metadata symbol annotation annotation-xml".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup hr html legend li main menu nav option optgroup search section select summary tbody textarea tfoot thead tr caption xmp".split())
#: A start tag closes these, looking no further out than the stops.
CLOSES: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "td", "th", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    **dict.fromkeys(("dt", "dd"), (frozenset({"dt", "dd"}), frozenset({"dl", "td", "th", "table"}))),
    **dict.fromkeys(("td", "th"), (frozenset({"td", "th", "caption"}), frozenset({"tr", "table"}))),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"}))),
}
_P_STOPS = frozenset("td th caption table button html object".split())
_CELL_STOPS = frozenset("td th caption table".split())
_TABLE_PARTS = frozenset("table td th tr tbody thead tfoot caption".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|[!?/][^>]*>)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MAYBE = re.compile(r"hidden|style|open|start|span|value|reversed", re.IGNORECASE)
_NAMED = re.compile(r"class|id", re.IGNORECASE)
_DECLARED = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.IGNORECASE)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_AT_BLOCK = re.compile(r"@([^{};]*)(?:;|\{((?:[^{}]|\{[^{}]*\})*)\})")
#: Media rules that hold: no condition but the kind of screen.
_MEDIA = re.compile(r"\s*media\s+(?:only\s+)?(?:all|screen)\s*\Z", re.IGNORECASE)
_NUMBER = re.compile(r"-?[0-9]{1,9}\Z")
_SPACE = " \t\n\r\f"
_COLLAPSE = re.compile(r"[ \t\n\r\f]+")
#: Cells up to this width set their column's; wider ones run on.
WIDEST = 60
#: Columns and rows that a cell can span (as in HTML).
_SPAN, _ROWS = 1000, 65534
_LISTS = frozenset("ul ol menu dir".split())


class Late:
    """The number of an item of a reversed list, which is known at the list's end."""

    __slots__ = ("lead", "number")

    def __init__(self, number: int) -> None:
        self.number, self.lead = number, 0

    def __str__(self) -> str:
        return f"{self.number}. ".rjust(self.lead)


class Box:
    """Text under layout: lines so far and what must come before the next word."""

    __slots__ = ("bullet", "indent", "late", "lines", "need", "space")

    def __init__(self) -> None:
        self.lines: list[list[str | Late]] = []
        self.late: Late | None = None
        self.need = 1  # lines that must start before the next word; above 1: blank ones
        self.space = False
        self.indent = 0
        self.bullet = ""

    def block(self, lines: int) -> None:
        self.need = max(self.need, lines)
        self.space = False

    def begin(self) -> list[str]:
        """The line that the next word goes to."""
        if self.need:
            if self.lines:
                self.lines += [[] for _ in range(self.need - 1)]
            if self.late:
                self.late.lead, line = self.indent, [self.late]
            else:
                lead = " " * max(0, self.indent - len(self.bullet)) + self.bullet
                line = [lead] if lead else []
            self.lines.append(line)
            self.bullet, self.late, self.need, self.space = "", None, 0, False
        return self.lines[-1]

    def text(self, s: str) -> None:
        flat = _COLLAPSE.sub(" ", s)
        words = flat.strip(" ")
        if not words:
            self.space |= bool(flat) and not self.need
            return
        if flat[0] == " ":
            self.space |= not self.need
        line = self.begin()
        if self.space and line:
            line.append(" ")
        line.append(words)
        self.space = flat[-1] == " "

    def raw(self, s: str) -> None:
        """Preformatted text."""
        for k, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                if self.need:
                    self.begin()
                self.need = 1
            if part:
                if self.need > 1 or not self.lines or self.need:
                    self.begin()
                self.lines[-1].append(part)

    def newline(self) -> None:
        if self.need:
            self.begin()
        self.need, self.space = 1, False

    def rows(self, rows: list[str]) -> None:
        """Lines that are laid out already."""
        self.block(1)
        for r in rows:
            self.begin().append(r)
            self.need = 1

    def done(self) -> list[str]:
        out = ["".join(map(str, x)).rstrip() for x in self.lines]
        while out and not out[-1]:
            out.pop()
        return out


class Columns:
    """Columns that cells of rows above still take: pieces with the row from which they are free again, and the gaps between them."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.pieces: dict[int, tuple[int, int]] = {}  # start -> (end, row)
        self.ends: dict[int, list[int]] = {}  # row -> starts of pieces that may end there
        self.gaps, self.until = [0], {0: 1 << 60}  # starts of gaps, and their ends

    def free(self, at: int) -> int:
        """The first free column from ``at`` on."""
        k = bisect_right(self.gaps, at) - 1
        if k >= 0 and at < self.until[self.gaps[k]]:
            return at
        return self.gaps[k + 1]

    def _piece(self, start: int, end: int, row: int) -> None:
        if start < end:
            insort(self.starts, start)
            self.pieces[start] = (end, row)
            self.ends.setdefault(row, []).append(start)

    def _lift(self, start: int) -> tuple[int, int]:
        del self.starts[bisect_left(self.starts, start)]
        return self.pieces.pop(start)

    def take(self, start: int, end: int, row: int) -> None:
        """From now on these columns are taken up to a row, whatever took them before."""
        k = max(0, bisect_right(self.starts, start) - 1)
        while k < len(self.starts) and self.starts[k] < end:
            own = self.starts[k]
            if self.pieces[own][0] <= start:
                k += 1
                continue
            upto, old = self._lift(own)
            self._piece(own, start, old)
            self._piece(end, upto, old)
            k = bisect_left(self.starts, start)
        k = max(0, bisect_right(self.gaps, start) - 1)
        while k < len(self.gaps) and self.gaps[k] < end:
            gap = self.gaps[k]
            if self.until[gap] <= start:
                k += 1
                continue
            upto = self.until.pop(gap)
            del self.gaps[k]
            for a, b in ((gap, start), (end, upto)):
                if a < b:
                    insort(self.gaps, a)
                    self.until[a] = b
            k = bisect_left(self.gaps, start)
        self._piece(start, end, row)

    def begin(self, row: int) -> None:
        """Frees what ends at this row."""
        for start in self.ends.pop(row, ()):
            if self.pieces.get(start, (0, -1))[1] != row:
                continue
            end, _ = self._lift(start)
            k = bisect_left(self.gaps, start)
            if k < len(self.gaps) and self.gaps[k] == end:
                end = self.until.pop(self.gaps.pop(k))
            if k and self.until[self.gaps[k - 1]] == start:
                start = self.gaps.pop(k - 1)
            insort(self.gaps, start)
            self.until[start] = end


class Table:
    __slots__ = ("caption", "cells")

    def __init__(self) -> None:
        self.cells: list[list[tuple[list[str], int, int]]] = []  # (lines, columns, rows) of each cell
        self.caption: list[str] = []

    def placed(self) -> list[list[tuple[int, list[str], int]]]:
        """(column, lines, columns) of each row's cells: a cell that spans rows takes its columns in those below."""
        out, taken = [], Columns()
        for k, row in enumerate(self.cells):
            taken.begin(k)
            own, at, long = [], 0, []
            for cell, span, rows in row:
                at = taken.free(at)
                own.append((at, cell, span))
                if rows > 1:
                    long.append((at, at + span, k + rows))
                at += span
            for one in long:
                taken.take(*one)
            out.append(own)
        return out

    def lines(self) -> list[str]:
        """Caption, then rows with cells padded to their column's width."""
        rows, widths = self.placed(), []
        for row in rows:
            for at, cell, span in row:
                if span == 1:
                    widths += [0] * (at + 1 - len(widths))
                    widths[at] = max([widths[at], *(len(x) for x in cell if len(x) <= WIDEST)])
        left = [0]  # where columns begin; an empty one has no width
        for w in widths:
            left.append(left[-1] + (w + 2 if w else 0))
        begin = lambda c: left[min(c, len(widths))]
        out = list(self.caption)
        for row in rows:
            for k in range(max((len(cell) for _, cell, _ in row), default=0)):
                line = ""
                for at, cell, _ in row:
                    line = line.ljust(begin(at)) + (cell[k] if k < len(cell) else "") + "  "
                out.append(line.rstrip())
        return out


class Element:
    __slots__ = ("count", "hidden", "indent", "items", "known", "name", "rows", "skip", "step", "undo", "visible")

    def __init__(self, name: str, hidden: bool, visible: bool) -> None:
        self.name, self.hidden, self.visible, self.rows = name, hidden, visible, 1
        self.count: int | None = None  # of an ordered list's next item
        self.step = 1  # from one item's number to the next
        self.items: list[Late] | None = None  # of a reversed list whose first number isn't known
        self.known = False  # whether an item of it gave its number
        self.indent = 0
        self.skip = False  # closed details: all but the summary is hidden
        self.undo: list[Rule] = []  # rules that this element brought a step on


class Rule:
    """A selector's compounds (tag, classes, id), outermost first, and how many of them the open elements fulfil in this order."""

    __slots__ = ("compounds", "met", "said")

    def __init__(self, compounds: list[tuple[str, frozenset, str]]) -> None:
        self.compounds, self.met = compounds, 0
        self.said: dict[str, tuple[tuple[bool, int, int], str]] = {}  # property -> (weight, value): the last that was said of it


def _key(compound: tuple[str, frozenset, str]) -> str:
    """Under which of its parts a compound is looked up."""
    tag, classes, id_ = compound
    return f"#{id_}" if id_ else f".{max(classes)}" if classes else tag


def _declared(style: str) -> dict[str, tuple[str, bool]]:
    """Of display and visibility what declarations say, and whether it is important; the last counts, of important ones if there are."""
    out: dict[str, tuple[str, bool]] = {}
    for name, value, important in _DECLARED.findall(style) if style else ():
        if important or not out.get(name.lower(), ("", False))[1]:
            out[name.lower()] = value.lower(), bool(important)
    return out


class Builder:
    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.open: dict[str, list[int]] = {}  # where on the stack elements of each name are
        self.boxes = [Box()]
        self.tables: list[Table] = []
        self.lists: list[Element] = []
        self.rules: dict[tuple, Rule] = {}
        self.by_key: dict[str, list[tuple[Rule, int]]] = {}  # (rule, which of its compounds)
        self.said = 0
        self.hidden = 0
        self.pre = 0

    def style(self, sheet: str) -> None:
        """Takes in a sheet's rules about what is seen."""
        sheet = _AT_BLOCK.sub(lambda m: m[2] if m[2] and _MEDIA.match(m[1]) else "", _CSS_COMMENT.sub("", sheet))
        for selectors, body in _RULE.findall(sheet):
            declared = _declared(body)
            for one in selectors.split(",") if declared else ():
                compounds, heavy = [], 0
                for part in one.split():
                    m = _SELECTOR.match(part)
                    names = re.findall(r"([.#])([\w-]+)", m[2]) if m else []
                    ids = [n for c, n in names if c == "#"]
                    if not m or len(ids) > 1 or not (m[1] or names):
                        break
                    compounds.append(("" if m[1] == "*" else (m[1] or "").lower(), frozenset(n for c, n in names if c == "."), ids[0] if ids else ""))
                    heavy += len(ids) * 10_000 + (len(names) - len(ids)) * 100 + bool(compounds[-1][0])
                else:
                    if compounds:
                        self._rule(compounds, heavy, declared)

    def _rule(self, compounds: list, heavy: int, declared: dict[str, tuple[str, bool]]) -> None:
        rule = self.rules.get(tuple(compounds))
        if rule is None:
            rule = self.rules[tuple(compounds)] = Rule(compounds)
            for k, c in enumerate(compounds):
                self.by_key.setdefault(_key(c), []).append((rule, k))
        self.said += 1
        for name, (value, important) in declared.items():
            weight = (important, heavy, self.said)
            if weight > rule.said.get(name, ((False, -1, 0), ""))[0]:
                rule.said[name] = weight, value

    def _ruled(self, name: str, attributes: dict[str, str]) -> tuple[dict[str, tuple[tuple[bool, int, int], str]], list[Rule]]:
        """What rules say of an element, and the rules that wait for one under such an element."""
        said: dict[str, tuple[tuple[bool, int, int], str]] = {}
        on = []
        classes, own = set(attributes.get("class", "").split()), attributes.get("id", "")
        for key in ("", name, *(f".{c}" for c in classes), f"#{own}"):
            for rule, k in self.by_key.get(key, ()):
                tag, needs, id_ = rule.compounds[k]
                if k > rule.met or tag not in ("", name) or not needs <= classes or id_ not in ("", own):
                    continue
                if k == len(rule.compounds) - 1:
                    for p, x in rule.said.items():
                        if x > said.get(p, ((False, -1, 0), "")):
                            said[p] = x
                elif k == rule.met:
                    on.append(rule)
        return said, on

    # ---- tree

    def start(self, name: str, source: str, closed: bool) -> None:
        attributes = {}
        if _MAYBE.search(source) or (self.rules and _NAMED.search(source)):
            for key, *value in _ATTRIBUTE.findall(source):
                attributes.setdefault(key.lower(), unescape("".join(value)))
        if name in BLOCKS and self.open.get("p"):
            self._close_within({"p"}, _P_STOPS)
        if name in CLOSES:
            self._close_within(*CLOSES[name])
        if name in ("td", "th") and self.tables and not self._in_row():
            self.start("tr", "", False)
        if name in VOID:
            self._void(name, attributes)
        elif not (closed and (self.open.get("svg") or self.open.get("math"))):
            self._push(name, attributes)

    def _place(self, name: str) -> int:
        """Where the innermost open element of this name is; -1 if there is none."""
        at = self.open.get(name)
        return at[-1] if at else -1

    def _nearest(self, names: frozenset) -> int:
        return max(map(self._place, names))

    def end(self, name: str) -> None:
        if name == "br":
            self._void("br", {})
        k = self._place(name)
        if k < 0 or k < self._nearest(frozenset({"table"}) if name in _TABLE_PARTS else _CELL_STOPS):
            return
        while len(self.stack) > k:
            self._pop()

    def _in_row(self) -> bool:
        return self._place("tr") > self._place("table")

    def _close_within(self, names: set | frozenset, stops: frozenset) -> None:
        """Closes the outermost of the names above the nearest stop, with all in it."""
        if not any(self.open.get(n) for n in names):
            return
        stop, cut = self._nearest(stops), len(self.stack)
        for n in names:
            at = self.open.get(n, ())
            if (k := bisect_right(at, stop)) < len(at):
                cut = min(cut, at[k])
        while len(self.stack) > cut:
            self._pop()

    # ---- layout

    @property
    def box(self) -> Box:
        return self.boxes[-1]

    def _push(self, name: str, attributes: dict[str, str]) -> None:
        declared = _declared(attributes.get("style", ""))
        said, on = self._ruled(name, attributes) if self.rules else ({}, [])
        of = {p: (declared[p][0] if p in declared and (p not in said or declared[p][1] or not said[p][0][0]) else said[p][1] if p in said else None) for p in ("display", "visibility")}
        shown = None if of["display"] is None else of["display"] != "none"
        visible = of["visibility"] == "visible" if of["visibility"] in ("visible", "hidden", "collapse") else None
        parent = self.stack[-1] if self.stack else None
        hidden = name in HIDDEN or ("hidden" in attributes and not shown) or shown is False or (name == "dialog" and "open" not in attributes)
        if parent and parent.skip and name != "summary":
            hidden = True
        e = Element(name, hidden, visible if visible is not None else parent is None or parent.visible)
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(e)
        for rule in on:
            rule.met += 1
            e.undo.append(rule)
        if name in _LISTS:
            self.lists.append(e)
        self.hidden += hidden
        if name == "details" and "open" not in attributes:
            e.skip = True
        if self.hidden:
            return
        box = self.box
        if name in BLOCKS or name == "text" and self.open.get("svg"):
            box.block(2 if name in PARAGRAPHS and not (name in ("ul", "ol") and self.open.get("li")) else 1)
        if name in ("pre", "xmp", "textarea"):
            self.pre += 1
        elif name in _LISTS:
            if name == "ol":
                start = attributes.get("start", "").strip()
                known = bool(_NUMBER.match(start))
                e.count = int(start) if known else 1
                if "reversed" in attributes:
                    e.step = -1
                    if not known:
                        e.count, e.items = 0, []
        elif name == "li":
            own = self.lists[-1] if self.lists else None
            box.bullet = "- "
            box.late = None
            if own and own.count is not None:
                value = attributes.get("value", "").strip()
                if given := bool(_NUMBER.match(value)):
                    own.count = int(value)
                box.bullet = f"{own.count}. "
                if own.items is not None:
                    own.known = own.known or given
                    if not own.known:
                        box.late = Late(own.count)
                        box.bullet = "0. "
                    own.items.append(box.late or Late(0))
                own.count += own.step
            e.indent = max(2, len(box.bullet))
            if not e.visible:
                box.bullet, box.late = "", None
            box.indent += e.indent
        elif name in ("dd", "blockquote"):
            e.indent = 4
            box.indent += 4
        elif name == "table":
            self.tables.append(Table())
        elif name == "tr" and self.tables:
            self.tables[-1].cells.append([])
        elif name in ("td", "th", "caption") and self.tables:
            span, rows = (attributes.get(x, "1").strip() for x in ("colspan", "rowspan"))
            e.count = min(_SPAN, max(1, int(span))) if re.fullmatch(r"[0-9]{1,6}", span) else 1
            e.rows = min(_ROWS, int(rows) or _ROWS) if re.fullmatch(r"[0-9]{1,6}", rows) else 1  # 0: all rows below
            self.boxes.append(Box())
            e.skip = False

    def _pop(self) -> None:
        e = self.stack.pop()
        name = e.name
        self.open[name].pop()
        for rule in e.undo:
            rule.met -= 1
        if name in _LISTS:
            self.lists.pop()
            for late in e.items or ():
                late.number += len(e.items)
        seen = not self.hidden
        self.hidden -= e.hidden
        if not seen:
            return
        box = self.box
        if name in ("td", "th", "caption") and self.tables and len(self.boxes) > 1:
            lines = self.boxes.pop().done()
            table = self.tables[-1]
            if name == "caption":
                table.caption += lines
            elif table.cells:
                table.cells[-1].append((lines, e.count or 1, e.rows))
            return
        if name == "table" and self.tables:
            box.rows(self.tables.pop().lines())
        if name in ("pre", "xmp", "textarea"):
            self.pre -= 1
        box.indent -= e.indent
        if name == "li":
            box.bullet, box.late = "", None
        if name in BLOCKS or name == "text" and self.open.get("svg"):
            box.block(2 if name in PARAGRAPHS and not (name in ("ul", "ol") and self.open.get("li")) else 1)

    def _unseen(self) -> bool:
        return bool(self.hidden) or (bool(self.stack) and (self.stack[-1].skip or not self.stack[-1].visible))

    def _void(self, name: str, attributes: dict[str, str]) -> None:
        if self._unseen():
            return
        if name == "br":
            self.box.newline()
        elif name == "hr":
            self.box.block(2)

    def text(self, s: str) -> None:
        if self._unseen():
            return
        if self.pre:
            self.box.raw(s)
        else:
            self.box.text(s)

    def finish(self) -> str:
        while self.stack:
            self._pop()
        return "\n".join(self.boxes[0].done())


def render(html: str | None) -> str:
    """The visible text of a page; null gives the empty text."""
    if not html:
        return ""
    builder, at = Builder(), 0
    limit = html.rfind(">") + 1  # a tag that no > ends is dropped
    while True:
        m = _TAG.search(html, at, limit)
        plain = html[at : m.start()] if m else html[at:]
        if not m and (cut := re.search(r"<[a-zA-Z/!?]", plain)):
            plain = plain[: cut.start()]
        if plain:
            builder.text(unescape(plain))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            builder.end(name)
            continue
        builder.start(name, m[3], m[3].endswith("/"))
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            body = html[at : close.start()] if close else html[at:]
            if name == "style":
                builder.style(body)
            builder.text(unescape(body) if name == "textarea" else body)
            at = close.start() if close else len(html)
            limit = max(limit, at)
            if not close:
                builder.end(name)
    return builder.finish()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["id"], pa.array([render(x) for x in b["html"].to_pylist()], pa.string())], ["id", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, text. Null html gives an empty text; repeated rows are rendered each; other columns,
    whatever their names, are not read. No shuffle: a page of any length is one task's, in one pass."""
    ship(pages.sparkSession)
    id_type = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return own.mapInArrow(_render, f"id {id_type}, text string").withColumnRenamed("id", id_col)


def digest(out: DataFrame, id_col: str = "page_id") -> DataFrame:
    return out.select(id_col, "text", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
