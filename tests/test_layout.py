import pytest

from quern.operators.layout import Glyphs, line_text, page_text, reading_order
from quern.operators.regions import Segment, cluster_lines, detect_formulas, detect_tables, is_math_font, page_blocks


def line(y, x0, s, w, font="Test"):
    return [{"font": font, "font_size": w, "x": x0 + i * w, "y": y, "w": w, "s": c} for i, c in enumerate(s)]


def words(y, x0, w, gap, *ws):
    out, x = [], x0
    for n, word in enumerate(ws):
        x += gap if n else 0
        for c in word:
            out.append({"font": "Test", "font_size": w, "x": x, "y": y, "w": w, "s": c})
            x += w
    return out


def lines_of(rows):
    g = Glyphs.of(rows)
    order = reading_order(g)
    return [line_text(g, ln.idx) for ln in order], order


def two_columns():
    rows = line(780, 63, "题" * 48, 9.7)
    for i in range(5):
        rows += line(760 - i * 14, 63, "左" * (12 if i == 4 else 23), 9.7) + line(760 - i * 14, 307, "右" * 23, 9.7)
    return rows


def test_title_then_left_then_right():
    texts, order = lines_of(two_columns())
    assert texts == ["题" * 48] + ["左" * 23] * 4 + ["左" * 12] + ["右" * 23] * 5
    assert order[1].join == "break" and order[6].join == "break"


def test_noise_in_a_baseline_is_one_line():
    rows = line(759.173150, 63, "对钢管约束效", 9.99) + line(759.173141, 63 + 7 * 9.99, "土柱的轴压力学性能", 9.99)
    assert lines_of(rows)[0] == ["对钢管约束效土柱的轴压力学性能"]


def test_mark_in_the_cell_before():
    rows = line(759.173150, 63, "对钢管约束效应进行分析", 9.99) + [{"font": "", "font_size": 9.99, "x": 73.0, "y": 759.658286, "w": 9.99, "s": "，"}]
    texts, _ = lines_of(rows)
    assert len(texts) == 1 and texts[0].startswith("对，钢")


def test_soft_wraps_and_indents():
    full = line(760, 72, "甲" * 33, 9.7)
    assert "\n" not in page_text(Glyphs.of(full + line(746, 72, "乙" * 33, 9.7)))
    assert "\n乙" in page_text(Glyphs.of(full + line(746, 91, "乙" * 30, 9.7)))


def test_columns_that_run_on():
    rows = [g for i in range(5) for g in line(760 - i * 14, 63, "左" * 23, 9.7) + line(760 - i * 14, 307, "右" * 23, 9.7)]
    texts, order = lines_of(rows)
    assert len(texts) == 10 and order[5].join != "break" and "左右" in page_text(Glyphs.of(rows))


def test_hyphen_and_space():
    assert "-" not in page_text(Glyphs.of(line(760, 72, "a" * 65 + "-", 5) + line(746, 72, "bcdef", 5)))
    assert "a bcdef" in page_text(Glyphs.of(line(760, 72, "a" * 65, 5) + line(746, 72, "bcdef", 5)))


def test_gaps_between_words():
    assert lines_of(words(760, 63, 4.4, 3.2, "Comparison", "of", "failure", "modes"))[0] == ["Comparison of failure modes"]
    assert lines_of(words(760, 63, 9.7, 3.2, "钢管", "混凝土"))[0] == ["钢管混凝土"]
    rows = words(760, 63, 4.4, 3.2, "abc", "def")
    rows.insert(3, {"font": "Test", "font_size": 4.4, "x": 63 + 3 * 4.4 + 1.0, "y": 760, "w": 1.2, "s": " "})
    assert lines_of(rows)[0] == ["abc def"]


@pytest.mark.parametrize("header", [False, True])
def test_narrow_book_with_a_wide_gutter(header):
    rows = []
    for i in range(8):
        rows += line(760 - i * 13, 36, "左" * 21, 9) + line(760 - i * 13, {1: 289.0, 4: 295.0}.get(i, 271.0), "右" * 20, 9)
    if header:
        rows += [{"font": "Test", "font_size": 7, "x": 600 + i * 7, "y": 800, "w": 7, "s": " "} for i in range(26)]
    texts = [t for t in lines_of(rows)[0] if t.strip()]
    assert ["左" in t for t in texts] == [True] * 8 + [False] * 8


def test_a_tables_gap_is_no_gutter():
    rows = [g for i in range(10) for g in line(760 - i * 14, 63, "甲" * 19, 9.8) + line(760 - i * 14, 381, "乙" * 15, 9.8)]
    texts, order = lines_of(rows)
    assert len(texts) == 10 and all(ln.column == 0 for ln in order)


def test_glyphs_without_size_go():
    rows = line(760, 63, "beamlocation", 9)
    rows[3:3] = [{"font": "T", "font_size": 0, "x": 8, "y": 760, "w": 0, "s": "y"}]
    rows += [{"font": "T", "font_size": 0, "x": 8, "y": y, "w": 0, "s": "n"} for y in (764, 760)]
    assert lines_of(rows)[0] == ["beamlocation"]
    assert reading_order(Glyphs.of([])) == []


def test_fragments_go_and_short_lines_stay():
    rows = line(760, 63, "theultimatestrengthis", 9.96) + [{"font": "Test", "font_size": 6.97, "x": 261, "y": 756.5, "w": 1.88, "s": "0"}]
    rows += line(753, 63, "proportionaltothecompressive", 9.96) + line(739, 63, "规定。", 9.96)
    assert lines_of(rows)[0] == ["theultimatestrengthis", "proportionaltothecompressive", "规定。"]


def test_lines_of_a_grid():
    one = cluster_lines([Segment(100.0, 0, 50), Segment(100.5, 40, 80), Segment(101.0, 75, 100)], 1.5)
    assert [(s.lo, s.hi) for s in one] == [(0, 100)]
    assert len(cluster_lines([Segment(100, 0, 50), Segment(100, 80, 100)], 1.5)) == 2


def grid(x0, y0, widths, heights):
    boxes, y = [], y0
    for h in heights:
        x = x0
        for w in widths:
            boxes.append((x, y, x + w, y + h))
            x += w
        y += h
    return boxes


def test_tables():
    frame = [(0.0, 0.0, 612.0, 792.0)]
    boxes = frame + grid(100.0, 600.0, [100, 100], [20, 20])
    rows = line(626, 110, "Name", 6) + line(626, 210, "Qty", 6) + line(606, 110, "Apple", 6) + line(606, 210, "3", 6)
    tables = detect_tables(Glyphs.of(rows), boxes)
    assert [t.text for t in tables] == ["Name | Qty\nApple | 3"]
    more = boxes + grid(100.0, 300.0, [100, 100], [20, 20])
    both = detect_tables(Glyphs.of(rows + line(326, 110, "A", 6) + line(306, 210, "B|", 6)), more)
    assert [t.text for t in both] == ["Name | Qty\nApple | 3", "A | \n | B\\|"]
    assert detect_tables(Glyphs.of(rows), []) == []
    blocks = page_blocks(Glyphs.of(line(700, 100, "before", 6) + rows + line(500, 100, "after", 6)), boxes)
    assert [(b.kind, b.content) for b in blocks] == [("text", "before"), ("table", "Name | Qty\nApple | 3"), ("text", "after")]


@pytest.mark.parametrize(("font", "math"), [("CambriaMath", 1), ("MTExtra", 1), ("MT Extra", 1), ("EuclidSymbol", 1), ("SymbolMT", 1), ("TimesNewRomanPSMT", 1), ("ZJSJGB", 1), ("SimSun", 0), ("Helvetica", 0)])
def test_math_fonts(font, math):
    assert is_math_font(font) == bool(math)


def glyph(s, x, y, font="CambriaMath", size=10.0):
    return {"font": font, "font_size": size, "x": x, "y": y, "w": 5.0, "s": s}


def formulas(*rows):
    return [f.text for f in detect_formulas(Glyphs.of(rows))]


def test_formulas():
    abc = [glyph(c, 200 + 6 * i, 500) for i, c in enumerate("a=bc")]
    assert formulas(*abc) == ["a=bc"]
    assert formulas(*[glyph("x", 200, 500), glyph("2", 205, 502)]) == ["2x"]
    assert formulas(*[glyph(c, 200 + 6 * i, 510) for i, c in enumerate("ab")], *[glyph(c, 200 + 6 * i, 498) for i, c in enumerate("cd")]) == ["ab\ncd"]
    assert formulas(glyph("当", 190, 500, "SimSun"), *abc) == []
    assert formulas(*line(500, 100, "plain", 6)) == []
    times = lambda s: [glyph(c, 200 + 6 * i, 500, "TimesNewRomanPSMT") for i, c in enumerate(s)]
    assert formulas(*times("English")) == [] and formulas(*times("5902027")) == [] and formulas(*times("a=b+c")) == ["a=b+c"]
    assert formulas(glyph("。", 200, 500), glyph("—", 206, 500)) == []
    blocks = page_blocks(Glyphs.of(line(600, 100, "before", 6) + abc), [])
    assert [b.kind for b in blocks] == ["text", "formula"] and blocks[1].left == 200
