"""Ruled tables and display formulas of a page, and the page as an ordered stream of blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from ..functions.text import SPACES, clean_text_py, normalize_text_py
from .layout import Glyphs, follow, page_text, reading_order

#: Fixed values, in points: lines of a grid; shortest side of a box; where stretches of a line meet; spans of the
#: columns of one table.
GRID_TOLERANCE, BOX_MIN, LINE_MEET, SPAN_TOLERANCE = 1.5, 3.0, 2.0, 5.0
#: Fixed values, in points: rows of a formula; what parts two formulas; how near text on the left makes one inline.
FORMULA_ROW, FORMULA_GAP, INLINE_GAP = 3.0, 8.0, 12.0
#: Parts of names of fonts that set formulas; of those one also sets ordinary text.
MATH_FONTS = ["math", "mtextra", "mt extra", "euclid", "symbol", "timesnewromanps", "zjsjgb", "zjsjgc", "zjsjgu"]
LOOSE_FONT = "timesnewromanps"
#: What proves a formula set in the loose font; what any formula has at least one of.
_PROOF = re.compile("[Ͱ-Ͽ∀-⋿=+±×÷−<>]")
_FORMULA = re.compile("[a-zA-Z0-9=+×÷±πθαβγρστφλμ∑∫√≥≤∞-]")


@dataclass
class Segment:
    """A horizontal or vertical line: its fixed coordinate and its extent."""

    fix: float
    lo: float
    hi: float


@dataclass
class Table:
    top: float
    bot: float
    text: str


@dataclass
class Formula:
    idx: list[int]
    top: float
    bot: float
    left: float
    right: float
    text: str


@dataclass
class Block:
    kind: str
    content: str
    left: float = 0.0
    right: float = 0.0
    top: float = 0.0
    bot: float = 0.0

    def row(self) -> dict:
        return dict(self.__dict__)


# ---------------------------------------------------------------- tables


def cluster_lines(lines: list[Segment], tolerance: float = GRID_TOLERANCE) -> list[Segment]:
    """Lines of nearly one coordinate (within ``tolerance`` of the group's first) become one for each stretch."""
    out: list[Segment] = []
    group: list[Segment] = []

    def close() -> None:
        stretches: list[Segment] = []
        for line in sorted(group, key=lambda s: s.lo):
            if stretches and line.lo <= stretches[-1].hi + LINE_MEET:
                stretches[-1].hi = max(stretches[-1].hi, line.hi)
            else:
                stretches.append(Segment(line.fix, line.lo, line.hi))
        out.extend(stretches)

    for line in sorted(lines, key=lambda s: s.fix):
        if group and line.fix - group[0].fix > tolerance:
            close()
            group = []
        group.append(line)
    if group:
        close()
    return out


def _ruling(lo: np.ndarray, hi: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Lines of one direction as rows (coordinate, begin, end), from the sides of boxes; without a page's frame, the
    outermost lines that run over more than half of the longest extent."""
    sides = [Segment(*x) for x in zip(np.concatenate([lo, hi]).tolist(), np.tile(from_, 2).tolist(), np.tile(to, 2).tolist(), strict=True)]
    lines = np.array([(s.fix, s.lo, s.hi) for s in cluster_lines(sides)]).reshape(-1, 3)
    if not len(lines):
        return lines
    outer = np.isin(lines[:, 0], [lines[:, 0].min(), lines[:, 0].max()])
    extent = lines[:, 2] - lines[:, 1]
    return lines[~(outer & (extent > extent.max() / 2))] if len(lines) > 1 else lines


def detect_tables(g: Glyphs, boxes: list[tuple[float, float, float, float]]) -> list[Table]:
    """Tables with a full grid, drawn as boxes (x0, y0, x1, y1), from the top.

    Upright lines of nearly one extent are the columns of a table, level lines within that extent its rows; a table has
    two of each, and text.
    """
    if not len(boxes):
        return []
    box = np.array(boxes, float).reshape(-1, 4)
    box = box[((box[:, 2:] - box[:, :2]) >= BOX_MIN).all(axis=1)]
    level, upright = _ruling(box[:, 1], box[:, 3], box[:, 0], box[:, 2]), _ruling(box[:, 0], box[:, 2], box[:, 1], box[:, 3])
    upright = upright[np.lexsort((upright[:, 2], upright[:, 1]))]
    tables, k = [], 0
    while k < len(upright):
        _, bot, top = upright[k]
        same = (np.abs(upright[k:, 1:] - (bot, top)) <= SPAN_TOLERANCE).all(axis=1)
        n = int(np.argmin(same)) if not same.all() else len(same)
        xs, ys = np.sort(upright[k : k + n, 0]), np.sort(level[(level[:, 0] >= bot - 2) & (level[:, 0] <= top + 2), 0])
        k += n
        if min(len(xs), len(ys)) > 1 and np.ptp(xs) > 0.5:
            inside = np.flatnonzero((g.y <= top + 5) & (g.y >= bot - 5))
            if (text := render_table(g, ys, xs, inside)).strip(SPACES):
                tables.append(Table(float(top), float(bot), text))
    return sorted(tables, key=lambda t: -t.top)


def render_table(g: Glyphs, ys: np.ndarray, xs: np.ndarray, idx: np.ndarray) -> str:
    """Rows from the top, cells parted by `` | ``; a cell's glyphs in the order of the source; empty rows left out.

    Half a point around a line belongs to both sides; the lower row and the left cell come first.
    """
    cells: dict[tuple[int, int], list[str]] = {}
    for i in idx:
        y, x = g.y[i], g.x[i]
        if not ys[0] - 1 <= y <= ys[-1] + 1 or not clean_text_py(g.s[i]):
            continue
        r, c = np.flatnonzero((y >= ys[:-1] - 0.5) & (y < ys[1:] + 0.5)), np.flatnonzero((x >= xs[:-1] - 0.5) & (x < xs[1:] + 0.5))
        if len(r) and len(c):
            cells.setdefault((int(r[0]), int(c[0])), []).append(g.s[i])
    rows = []
    for r in range(len(ys) - 2, -1, -1):
        row = [clean_text_py("".join(cells.get((r, c), []))).replace("|", "\\|") for c in range(len(xs) - 1)]
        if any(row):
            rows.append(" | ".join(row))
    return "\n".join(rows)


# ---------------------------------------------------------------- formulas


@lru_cache(4096)
def is_math_font(font: str) -> bool:
    return any(part in font.lower() for part in MATH_FONTS)


@dataclass
class _Row:
    top: float
    bot: float
    idx: list[int] = field(default_factory=list)


def detect_formulas(g: Glyphs) -> list[Formula]:
    """Display formulas: rows of glyphs in mathematical fonts, joined where they stand close, unless text stands right
    before them, or their only font also sets ordinary text and nothing in them is mathematical."""
    fonts = g.font.tolist()
    known = {f for f in set(fonts) if is_math_font(f)}
    if not known:
        return []
    math = np.array([f in known for f in fonts], bool)
    own = np.flatnonzero(math)
    part = max(FORMULA_GAP, 1.5 * float(np.sort(g.size[own])[len(own) // 2]))
    rows: list[_Row] = []
    for i in own[np.lexsort((own, g.x[own], -g.y[own]))].tolist():
        if not rows or abs(g.y[i] - rows[-1].top) > FORMULA_ROW:
            rows.append(_Row(g.y[i], g.y[i]))
        rows[-1].idx.append(i)
        rows[-1].bot = min(rows[-1].bot, g.y[i])
    regions: list[list[_Row]] = []
    for row in rows:
        if regions and regions[-1][-1].bot - row.top <= part:
            regions[-1].append(row)
        else:
            regions.append([row])
    text = np.flatnonzero(~math & np.array([bool(s.strip(SPACES)) for s in g.s], bool))
    found = []
    for region in regions:
        if any(_beside(g, row, text) for row in region):
            continue
        idx = [i for row in region for i in row.idx]
        flat = "\n".join(t for t in (clean_text_py("".join(g.s[i] for i in row.idx)) for row in region) if t)
        bare = clean_text_py(flat)
        strong = any(LOOSE_FONT not in g.font[i].lower() for i in idx)
        if len(bare) >= 2 and _FORMULA.search(bare) and (strong or _PROOF.search(flat)):
            found.append(Formula(idx, float(g.y[idx].max()), float(g.y[idx].min()), float(g.x[idx].min()), float(g.x[idx].max()), flat))
    return found


def _beside(g: Glyphs, row: _Row, text: np.ndarray) -> bool:
    left = g.x[row.idx].min()
    return bool(((np.abs(g.y[text] - row.top) <= FORMULA_ROW) & (g.x[text] >= left - INLINE_GAP) & (g.x[text] <= left)).any())


# ---------------------------------------------------------------- blocks


def page_blocks(page: Glyphs, boxes: list[tuple[float, float, float, float]], bad_fonts: set[str] = frozenset(), *, by_width: bool = False) -> list[Block]:
    """The page as blocks: each table and formula where its first glyph is read, text in between.

    Glyphs beside a table, at its height, are taken for part of it; with ``by_width`` only those within its width.
    """
    g = page.take(np.flatnonzero([f not in bad_fonts for f in page.font])) if bad_fonts else page
    tables, formulas = detect_tables(g, boxes), detect_formulas(g)
    if not tables and not formulas:
        return [Block("text", normalize_text_py(page_text(g)))]
    owner: dict[int, Formula | Table] = {i: f for f in formulas for i in f.idx}
    for table in reversed(tables):  # tables come before formulas, the upper before the lower
        inside = (g.y >= table.bot - 1) & (g.y <= table.top + 1)
        if by_width:
            near = [b for b in boxes if b[1] >= table.bot - 5 and b[3] <= table.top + 5]
            inside &= (g.x >= min(b[0] for b in near) - 1) & (g.x <= max(b[2] for b in near) + 1) if near else True
        owner |= dict.fromkeys(np.flatnonzero(inside).tolist(), table)
    blocks: list[Block] = []
    seen: set[int] = set()
    text = ""

    def close() -> None:
        nonlocal text
        if whole := normalize_text_py(text):
            blocks.append(Block("text", whole))
        text = ""

    for n, line in enumerate(reading_order(g)):
        for k, i in enumerate(line.idx):
            region = owner.get(i)
            if region is None:
                if k == 0 and n and text:
                    text = follow(text, line.join)
                text += g.s[i]
            elif id(region) not in seen:
                seen.add(id(region))
                close()
                if isinstance(region, Table):
                    blocks.append(Block("table", region.text))
                else:
                    blocks.append(Block("formula", region.text, region.left, region.right, region.top, region.bot))
    close()
    return blocks
