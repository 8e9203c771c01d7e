from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions.text import SPACES
from quern.operators.chunking import chunk_documents, chunk_pages, count_kinds, effective, split_blocks, split_table, split_text


def test_short_overlap_blank_and_pages():
    assert split_text("hello world", 800, 100) == ["hello world"]
    pieces = split_text("这是一句十六个字的中文测试句子。" * 50, 60, 15)
    assert len(pieces) >= 2 and len(pieces[0]) <= 75
    assert split_text("   \n  ", 100, 20) == [] and split_text(None) == []
    assert [c["page"] for c in split_blocks([[{"kind": "text", "content": "a"}], [{"kind": "text", "content": "b"}]], 1000, 0)] == [1, 2]


def test_sizes_that_do_not_fit_are_replaced():
    assert effective(0, 10) == (800, 10) and effective(100, 100) == (100, 25) and effective(None, None) == (800, 0)


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\n。;x", max_size=300), st.integers(1, 40), st.integers(0, 60))
def test_windows_cover_the_text_and_end(text, size, overlap):
    whole = text.strip(SPACES)
    at = 0
    for piece in split_text(text, size, overlap):
        assert 0 < len(piece) <= size
        found = whole.find(piece)
        assert found >= 0
        at += 1
    assert at <= len(whole)
    joined = "".join(split_text(text, size, 0))
    assert [c for c in joined if c not in SPACES] == [c for c in whole if c not in SPACES]


def test_large_overlap_ends():
    assert split_text("句子很长没有边界" * 400, 800, 600)


def test_table_rows_stay_whole_under_their_header():
    table = "名称 | 数量\n" + "\n".join(f"条目{i} | {i} | x" for i in range(20))
    pieces = split_table(table, 60, 0)
    assert len(pieces) >= 2 and all(p.startswith("名称 | 数量\n") for p in pieces)
    assert sorted(line for p in pieces for line in p.split("\n")[1:]) == sorted(table.split("\n")[1:])


def test_table_without_columns_or_rows_is_text():
    text = "首行是一个句子。\n" + "\n".join(f"行{i}没有单元格" for i in range(15))
    pieces = split_table(text, 120, 0)
    assert len(pieces) >= 1 and sum(p.count("首行") for p in pieces) == 1
    assert split_table("a | b | c", 60, 0) == ["a | b | c"]


def test_blocks_of_a_page():
    block = lambda kind, content: {"kind": kind, "content": content, "left": 1.0, "right": 2.0, "top": 3.0, "bot": 4.0}
    mixed = [[block("text", "一"), block("table", "a | b | c\n1 | 2 | 3"), block("text", "二")]]
    assert [(c["kind"], c["content"]) for c in split_blocks(mixed)] == [("text", "一\n\n二"), ("table", "a | b | c\n1 | 2 | 3")]
    slivers = [[block("text", "a"), block("formula", " x=1 "), block("text", "b"), block("formula", "y=2"), block("text", "c"), block("formula", "  ")]]
    found = list(split_blocks(slivers))
    assert [c["kind"] for c in found] == ["text", "formula", "formula"] and found[1]["content"] == "x=1" and found[1]["left"] == 1.0


def test_dataframes(spark):
    pages = spark.createDataFrame([(1, 1, "one. two. three."), (2, 1, None), (3, 2, "")], "document_id long, page int, text string")
    rows = chunk_pages(pages, keys=["document_id"], size=6, overlap=0).collect()
    assert [r.content for r in sorted(rows, key=lambda r: r.pos)] == ["one. t", "wo. th", "ree."]
    docs = spark.createDataFrame(
        [("d", [[("text", "abc", 0.0, 0.0, 0.0, 0.0)], [("formula", "x=1", 1.0, 2.0, 3.0, 4.0)]]), ("e", []), ("f", None)],
        "document_id string, pages array<array<struct<kind: string, content: string, left: double, right: double, top: double, bot: double>>>",
    )
    cut = chunk_documents(docs)
    assert [(r.document_id, r.idx, r.page, r.kind) for r in cut.orderBy("idx").collect()] == [("d", 0, 1, "text"), ("d", 1, 2, "formula")]
    assert count_kinds(cut, "document_id").first().formula_chunks == 1
