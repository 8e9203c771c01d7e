"""Reading order of a page's glyphs: rows, columns, lines and how lines join. Coordinates in points, y upward.

Works on one page at a time; ``pages`` applies it to DataFrames of pages. What concerns all glyphs is done on arrays,
what concerns one line, which is a handful of glyphs, on lists: calls on tiny arrays would cost far more than the work.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from ..functions.text import SPACES

#: Fixed values, in points: baselines of one line; narrowest and basic widest gutter, and its widest on any page.
LINE_TOLERANCE, GUTTER_MIN, GUTTER_BASE, GUTTER_CAP = 2.0, 8.0, 36.0, 96.0
#: Rows a gutter needs; share of the page's width where it may lie; share of the width it may take.
GUTTER_ROWS, GUTTER_FROM, GUTTER_TO, GUTTER_SHARE = 3, 0.3, 0.7, 0.15
#: Fixed values, in font sizes: an indent or a short line; a gap between words; a fragment's size to its neighbours'.
INDENT, WORD_GAP, FRAGMENT = 1.5, 0.15, 0.85
#: Closing marks that never begin a line.
CLOSING = set("，。、；：？！）】》」』”")
LEFT, RIGHT, FULL = 0, 1, 2
_BLANK = set(SPACES)
_LATIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


@dataclass
class Glyphs:
    font: np.ndarray
    size: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    s: np.ndarray

    @classmethod
    def of(cls, rows: Iterable[Mapping]) -> Glyphs:
        rows = list(rows)
        text = lambda k: np.array([r[k] or "" for r in rows], object)
        real = lambda k: np.array([r[k] or 0.0 for r in rows], float)
        return cls(text("font"), real("font_size"), real("x"), real("y"), real("w"), text("s"))

    def __len__(self) -> int:
        return len(self.x)

    def take(self, which: np.ndarray) -> Glyphs:
        return Glyphs(*(v[which] for v in (self.font, self.size, self.x, self.y, self.w, self.s)))

    @cached_property
    def right(self) -> np.ndarray:
        return self.x + self.w

    @cached_property
    def lists(self) -> tuple[list[float], list[float], list[float], list[float], list[str]]:
        """size, x, right, w and s as lists."""
        return self.size.tolist(), self.x.tolist(), self.right.tolist(), self.w.tolist(), self.s.tolist()

    @cached_property
    def plain(self) -> bool:
        """Do all places compare, so that lists sort as arrays do?"""
        return not (np.isnan(self.x).any() or np.isnan(self.right).any())

    def span(self, idx: list[int]) -> tuple[float, float]:
        if not self.plain:
            return float(self.x[idx].min()), float(self.right[idx].max())
        _, x, right, _, _ = self.lists
        return min([x[i] for i in idx]), max([right[i] for i in idx])

    def across(self, idx: list[int]) -> list[int]:
        """``idx`` from left to right."""
        return sorted(idx, key=self.lists[1].__getitem__) if self.plain else np.array(idx)[np.argsort(self.x[idx], kind="stable")].tolist()


@dataclass
class Line:
    """``join``: how it follows the line before: ``break``, ``hyphen`` (which goes), ``space`` or ``none``. ``text`` and
    ``size`` are those of its glyphs."""

    y: float
    column: int
    idx: list[int]
    x0: float
    x1: float
    join: str = "none"
    text: str = ""
    size: float = 0.0


def font_size(g: Glyphs, idx: list[int]) -> float:
    """The upper median of the sizes there are, else 0."""
    size = g.lists[0]
    sizes = sorted([size[i] for i in idx if size[i] > 0])
    return sizes[len(sizes) // 2] if sizes else 0.0


def line_text(g: Glyphs, idx: list[int], size: float | None = None) -> str:
    """A line's glyphs, with a blank where only a gap parts two Latin words. ``size``: the line's, where it is known."""
    gap = WORD_GAP * (font_size(g, idx) if size is None else size)
    _, x, _, w, s = g.lists
    if gap <= 0:
        return "".join([s[i] for i in idx])
    out: list[str] = []
    before = None
    for i in idx:
        if before is not None and x[i] - x[before] - w[before] > gap and s[before][-1:] in _LATIN and s[i][:1] in _LATIN:
            out.append(" ")
        out.append(s[i])
        before = i
    return "".join(out)


def rows_of(g: Glyphs) -> list[list[int]]:
    """Glyphs by row from the top, each from left to right. A row holds what lies near its first glyph."""
    order = np.lexsort((np.arange(len(g)), g.x, -g.y))
    number, starts, first = [], [], None
    for k, y in enumerate(g.y[order].tolist()):
        if first is None or abs(y - first) > LINE_TOLERANCE:
            starts.append(k)
            first = y
        number.append(len(starts))
    flat = order[np.lexsort((g.x[order], number))].tolist()
    return [flat[a:b] for a, b in zip(starts, [*starts[1:], len(flat)], strict=True)]


def find_gutter(g: Glyphs, rows: list[list[int]], x0: float, width: float) -> tuple[float, float] | None:
    """The white channel between two columns, if the page has one.

    Rows are counted over bins of a point; the widest stretch of the middle that (nearly) fewest rows cover is the
    valley. The gaps within rows that meet it are intersected, which gives the channel's straight edges.
    """
    if width < 3 * GUTTER_MIN or len(rows) < GUTTER_ROWS:
        return None
    bins = int(width) + 1
    sizes = np.fromiter(map(len, rows), int, len(rows))
    flat, starts = np.fromiter((i for row in rows for i in row), int, int(sizes.sum())), np.cumsum(sizes) - sizes
    x, ends = g.x[flat], g.right[flat]
    # a row counts once where its glyphs overlap: bins of all rows on one line, and of each stretch its two ends
    ahead = np.repeat(np.arange(len(rows)) * (bins + 2), sizes)
    begin, end = (np.minimum(np.maximum((v - x0).astype(int), 0), bins - 1) + ahead for v in (x, ends))
    good = begin <= end
    order = np.argsort(begin[good], kind="stable")
    begin, end, ahead = begin[good][order], np.maximum.accumulate(end[good][order]), ahead[good][order]
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1] + 1
    last = np.append(new[1:], True)
    counts = np.cumsum(np.bincount((begin - ahead)[new], minlength=bins + 1) - np.bincount((end - ahead)[last] + 1, minlength=bins + 1))[:bins]
    first, last = (min(max(int(width * share), 0), bins - 1) for share in (GUTTER_FROM, GUTTER_TO))
    middle = counts[first : last + 1]
    low = np.concatenate([[False], middle <= middle.min() + 1, [False]])
    edges = np.flatnonzero(low[1:] != low[:-1]).reshape(-1, 2)
    valley = edges[np.argmax(edges[:, 1] - edges[:, 0])] + first + x0
    lo, hi = ends[:-1], x[1:]
    wide = hi - lo >= GUTTER_MIN
    wide[starts[1:] - 1] = False  # from a row's last glyph to the next row's first
    met = wide & (hi >= valley[0]) & (lo <= valley[1])
    if met.sum() < GUTTER_ROWS:
        return None
    left, right = float(lo[met].max()), float(hi[met].min())
    if not GUTTER_MIN <= right - left <= min(max(GUTTER_BASE, GUTTER_SHARE * width), GUTTER_CAP):
        return None
    if (np.minimum.reduceat(x, starts) < left).sum() < GUTTER_ROWS or (np.maximum.reduceat(ends, starts) > right).sum() < GUTTER_ROWS:
        return None
    return left, right


def _segments(g: Glyphs, row: list[int], gutter: tuple[float, float] | None) -> list[tuple[int, list[int]]]:
    if gutter is None:
        return [(LEFT, row)]
    _, x, _, w, _ = g.lists
    middle = sum(gutter) / 2
    left, right = [i for i in row if x[i] + w[i] / 2 < middle], [i for i in row if not x[i] + w[i] / 2 < middle]
    if not left or not right:
        return [(LEFT, left)] if left else [(RIGHT, right)]
    return [(LEFT, left), (RIGHT, right)] if g.span(right)[0] - g.span(left)[1] >= GUTTER_MIN else [(FULL, row)]


def _restore_marks(g: Glyphs, idx: list[int]) -> list[int]:
    """Closing marks drawn inside the cell of the glyph before them go behind the one they belong to."""
    _, x, _, w, s = g.lists
    idx = list(idx)
    for k in range(1, len(idx)):
        b = idx[k]
        if s[b] in CLOSING:
            a = idx[k - 1]
            if s[a] not in CLOSING and x[b] - x[a] < w[a] * 0.5:
                idx[k - 1], idx[k] = b, a
    return idx


def lines_of(g: Glyphs, rows: list[list[int]], gutter: tuple[float, float] | None) -> list[Line]:
    """Lines of each column from the top; pieces of a column on nearly one baseline are one line."""
    height = g.y.tolist()
    top = (lambda row: max([height[i] for i in row])) if not np.isnan(g.y).any() else (lambda row: float(g.y[row].max()))
    if gutter is None and g.plain:  # rows stand apart, and each begins with its leftmost glyph
        _, x, right, _, _ = g.lists
        cut, lines = [], [Line(top(row), LEFT, row, x[row[0]], max([right[i] for i in row])) for row in rows]
    else:
        cut, lines = [(y, column, part, *g.span(part)) for row in rows for y in (top(row),) for column, part in _segments(g, row, gutter)], []
    cut.sort(key=lambda p: (-p[0], p[1], p[3]))
    latest: dict[int, Line] = {}
    mended: set[int] = set()  # lines of more pieces than one
    for y, column, part, x0, x1 in cut:
        line = latest.get(column)
        if line is not None and line.y - y <= LINE_TOLERANCE:
            line.idx = line.idx + part
            line.x0, line.x1 = min(line.x0, x0), max(line.x1, x1)
            mended.add(id(line))
        else:
            latest[column] = Line(y, column, part, x0, x1)
            lines.append(latest[column])
    marks, sizes = not CLOSING.isdisjoint(g.lists[4]), set(g.lists[0])
    same = sizes.pop() if len(sizes) == 1 else 0.0
    for line in lines:
        if id(line) in mended:
            line.idx = g.across(line.idx)
        if marks:
            line.idx = _restore_marks(g, line.idx)
        line.size = same if same > 0 else font_size(g, line.idx)
        line.text = line_text(g, line.idx, line.size)
    return lines


def _in_order(lines: list[Line]) -> list[Line]:
    """Full-width lines part the page into bands; in a band the left column comes before the right."""
    out: list[Line] = []
    band: list[Line] = []
    for line in [*lines, None]:
        if line is None or line.column == FULL:
            out += sorted(band, key=lambda b: b.column)
            band = []
            if line is not None:
                out.append(line)
        else:
            band.append(line)
    return out


def _without_fragments(lines: list[Line]) -> list[Line]:
    sizes = [line.size for line in lines]
    beside = [max(sizes[i - 1] if i else 0.0, sizes[i + 1] if i + 1 < len(sizes) else 0.0) for i in range(len(sizes))]
    return [line for line, size, near in zip(lines, sizes, beside, strict=True) if not (near > 0 and size < FRAGMENT * near and len(line.text) <= 2)]


def _join(before: Line, line: Line, right: float, left: float) -> str:
    a, b = before.text, line.text
    if not a or not b:
        return "break"
    em = line.size or before.size or 10.0
    if (left > 0 and line.x0 - left >= INDENT * em) or (right > 0 and right - before.x1 >= INDENT * em):
        return "break"
    if len(a) > 1 and a.endswith("-") and b[0] in _LATIN:
        return "hyphen"
    return "space" if a[-1] in _LATIN and b[0] in _LATIN else "none"


def reading_order(page: Glyphs) -> list[Line]:
    """The page's lines in reading order; ``idx`` are numbers of the page's glyphs. Glyphs of no size are left out."""
    there = np.flatnonzero((page.w > 0.01) | (page.size > 0.01))
    g = page.take(there) if len(there) < len(page) else page
    if not len(g):
        return []
    inked = [i for i, s in enumerate(g.lists[4]) if s and (s[0] not in _BLANK or s.strip(SPACES))]
    x0, x1 = g.span(inked) if inked else (0.0, 0.0)
    rows = rows_of(g)
    lines = lines_of(g, rows, find_gutter(g, rows, x0, x1 - x0) if x1 > x0 else None)
    edges = {FULL: (x0, x1)}
    for column in (LEFT, RIGHT):
        own = [line for line in lines if line.column == column]
        edges[column] = (min(line.x0 for line in own), max(line.x1 for line in own)) if own else (x0, x1)
    lines = _without_fragments(_in_order(lines))
    for before, line in zip(lines, lines[1:], strict=False):
        full = FULL in (before.column, line.column)
        line.join = "break" if full else _join(before, line, edges[before.column][1], edges[line.column][0])
    if g is not page:
        numbers = there.tolist()
        for line in lines:
            line.idx = [numbers[i] for i in line.idx]
    return lines


def page_text(page: Glyphs) -> str:
    """The page's text: lines that run on are joined, paragraphs and columns parted by a line end."""
    out = ""
    for n, line in enumerate(reading_order(page)):
        if n:
            out = follow(out, line.join)
        out += line.text
    return out


def follow(text: str, join: str) -> str:
    """``text`` as it stands before a line that joins it so."""
    if join == "hyphen":
        return text.removesuffix("-")
    return text + {"break": "\n", "space": " "}.get(join, "")
