"""What keeps queries within bounds on large tables, seen on small ones."""

import pytest
from pyspark.sql import functions as F

from quern.operators import pages
from quern.operators.layout import Glyphs
from quern.operators.regions import page_blocks
from quern.plans.queries import QUERIES

from .conftest import SF


@pytest.fixture
def plain_session(spark):
    """A session with Spark's own sizes of Arrow batches."""
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    return spark


def largest_batch(spark):
    """Bytes of the largest batch in which 2,000 rows of 20 KB come to Python as this session is now."""

    def run(batches):
        for b in batches:
            yield b.select([]).from_pydict({"n": [b.nbytes]})

    rows = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("t"))
    return rows.mapInArrow(run, "n bigint").agg(F.max("n")).first()[0]


def one_page(spark, glyphs):
    return spark.createDataFrame([(1, 1, glyphs, None)], f"document_id long, page int, glyphs {pages.GLYPHS}, rects {pages.RECTS}")


@pytest.mark.parametrize("name", ["page_columns", "page_layout"])
def test_pages_go_to_python_in_bounded_batches(plain_session, name):
    QUERIES[name](plain_session, SF)
    assert largest_batch(plain_session) < 16 << 20


def test_a_null_glyph_is_an_error_of_its_page_alone(spark):
    g = {"font": None, "font_size": 10.0, "x": 60.0, "y": 700.0, "w": 5.0, "s": "a"}
    rows = one_page(spark, [g, None]).unionByName(one_page(spark, [g]).withColumn("page", F.lit(2))).unionByName(one_page(spark, None).withColumn("page", F.lit(3)))
    got = {r.page: (r.blocks, r.error) for r in pages.extract_blocks(rows.coalesce(1), drop_bad_fonts=False).collect()}
    assert got[1][0] == [] and got[1][1].startswith("TypeError")
    assert got[2][0][0].content == "a" and got[2][1] is None and got[3][0][0].content == ""


def test_bad_fonts_are_counted_as_before(spark):
    """Odd glyphs: null fonts and signs, NUL, half of a font lost, and a document over two pages."""
    g = lambda font, s: {"font": font, "font_size": 1.0, "x": 0.0, "y": 0.0, "w": 1.0, "s": s}
    rows = [(1, 1, [g("A", "�"), g("A", "x"), g("B", "\x00"), g(None, "�")]), (1, 2, [g("A", "�"), g("C", None), None]), (2, 1, [g("A", "�"), g("A", "x")]), (3, 1, None), (4, 1, [])]
    df = spark.createDataFrame([(*r, None) for r in rows], f"document_id long, page int, glyphs {pages.GLYPHS}, rects {pages.RECTS}")
    assert set(map(tuple, pages.bad_fonts(df).collect())) == {(1, "A"), (1, "B"), (1, None)}


def test_no_glyph_is_shuffled_for_the_layout(spark, capsys):
    QUERIES["page_layout"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and not any("Exchange" in line and "glyphs" in line for line in plan.split("\n"))
    nodes = plan.split("MapInArrow")
    assert "Join" not in nodes[1].split("Generate")[0]  # documents meet their fonts below the making of pages


def test_a_page_of_many_lines_takes_no_calls_on_tiny_arrays():
    """Counts calls, not seconds: two a glyph at most go to functions written in Python or C of numpy."""
    import sys

    rows = [{"font": "F1", "font_size": 10.0, "x": 60.0 + k % 5 * 80, "y": 700.0 - k // 5 * 14, "w": 20.0, "s": "word"} for k in range(2400)]
    page, calls = Glyphs.of(rows), [0]

    def count(frame, event, arg):
        calls[0] += event == "c_call" and "numpy" in f"{getattr(arg, '__module__', '')} {type(getattr(arg, '__self__', None)).__module__}"

    sys.setprofile(count)
    try:
        blocks = page_blocks(page, [])
    finally:
        sys.setprofile(None)
    assert len(blocks) == 1 and calls[0] < 240


def vectors_of(n, ids=0):
    import numpy as np
    import pandas as pd

    m = np.random.default_rng(n).integers(-3, 4, (n, 8)).astype(float)  # many ties
    return pd.DataFrame({"document_id": np.arange(n) + ids, "page": 1, "idx": 0, "qid": np.arange(n), "user_id": [f"u{i % 3}" for i in range(n)], "document_ids": [[str(i), "7", "9"] if i % 5 == 0 else None for i in range(n)], "embedding": list(m + 0.5)})


def test_scores_are_held_a_piece_at_a_time():
    import tracemalloc

    from quern.operators.retrieval import _best

    queries, chunks = vectors_of(1500), vectors_of(6000)
    best = _best(queries, 3)
    tracemalloc.start()
    best(chunks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20  # all scores at once are 72 MB, and are copied several times


def test_pieces_of_scores_give_the_same(monkeypatch):
    from quern.operators import retrieval

    def pairs():
        found = retrieval._best(vectors_of(60), 2)(vectors_of(200))
        first = found.sort_values(["score", "document_id"], ascending=[False, True]).groupby("qid").head(2)
        return sorted(zip(first["qid"], first["document_id"], first["score"], strict=True))

    whole = pairs()
    monkeypatch.setattr(retrieval, "SCORES", 300)
    monkeypatch.setattr(retrieval, "GATHER_ROWS", 70)
    assert pairs() == whole and all(d in (q, 7, 9) for q, d, _ in whole if q % 5 == 0)


@pytest.mark.parametrize("name", ["threshold_search", "vector_fill", "vector_topk_batch", "hybrid_gate", "chunk_recall", "gate_states", "chunk_documents_by_size"])
def test_rows_go_to_python_in_bounded_batches(plain_session, name):
    QUERIES[name](plain_session, SF)
    assert largest_batch(plain_session) < 16 << 20


def test_no_text_is_shuffled_for_a_hybrid_search(spark, capsys):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES["hybrid_search"](spark, SF).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = capsys.readouterr().out
    moved = [part for part in plan.split("\n\n") if ") Exchange" in part.split("\n")[0]]
    assert moved and not any("content" in part or "text#" in part for part in moved)


def test_rank_in_python_is_the_columns(spark):
    import random

    import numpy as np

    from quern.functions.similarity import ts_rank
    from quern.operators.retrieval import _rank_of

    draw = random.Random(3)
    rows = [{t: sorted(draw.sample(range(m), min(m, n))) for t, n in zip("abc"[:terms], (3, 40, 400), strict=False)} for terms in (1, 2, 3) for m in (5, 300, 20_000)]
    df = spark.createDataFrame([(i, [(t, p) for t, ps in r.items() for p in ps]) for i, r in enumerate(rows)], "i int, hits array<struct<t: string, p: int>>")
    got = {r.i: r.s for r in df.select("i", ts_rank(F.col("hits")).alias("s")).collect()}
    assert [_rank_of([np.array(ps) for ps in r.values()]) for r in rows] == pytest.approx([got[i] for i in range(len(rows))], abs=1e-9)


def test_full_text_looks_no_pair_of_places_up_in_rows(spark, capsys):
    from quern.operators import retrieval

    rows = [(1, "d", 1, 0, "u", "alpha beta alpha"), (2, "e", 1, 0, "v", "alpha beta"), (3, "f", 1, 0, "u", "alpha"), (4, "g", 1, 0, "u", None)]
    chunks = spark.createDataFrame(rows, "id int, document_id string, page int, idx int, user_id string, content string")
    asked = spark.createDataFrame([(1, "Alpha beta", None), (2, "beta alpha", "u"), (3, "alpha", ""), (4, "!", None)], "qid int, text string, user_id string")
    found = retrieval.fulltext_search(chunks, asked, 5)
    by_index = retrieval.fulltext_search(chunks, asked, 5, index=retrieval.inverted_index(chunks))
    columns = ["qid", "document_id", "score", "rank"]
    assert sorted(found.select(columns).collect()) == sorted(by_index.select(columns).collect()) and found.count() == 6
    found.explain()
    assert "collect_list" not in capsys.readouterr().out


def test_a_gate_bounds_its_batches(plain_session):
    from quern.operators.evaluation import chunk_gate

    chunks = plain_session.createDataFrame([("d", 1, 0, "some text")], "document_id string, page int, idx int, content string")
    facts = plain_session.createDataFrame([("f", "d", 1, "me te")], "fact_id string, document_id string, page int, quote string")
    assert chunk_gate(facts, chunks).first().state == "OK" and largest_batch(plain_session) < 16 << 20


def test_ranks_of_quotes_bound_their_batches(plain_session):
    from quern.operators.evaluation import chunk_ranks

    hits = plain_session.createDataFrame([(1, 2, "some text"), (1, 1, "other")], "qid int, rank int, content string")
    evidence = plain_session.createDataFrame([(1, "f", "me te")], "qid int, fact_id string, quote string")
    assert chunk_ranks(evidence, hits).first().chunk_rank == 2 and largest_batch(plain_session) < 16 << 20


def test_passages_meet_texts_in_blocks_of_bounded_characters(spark, monkeypatch):
    from quern.operators import retrieval as r

    chunks = spark.createDataFrame([(n, 1, 0, f"text number {n} ends") for n in range(40)], "document_id long, page int, idx int, content string")
    passages = spark.createDataFrame([(n, f"number {n} e") for n in range(0, 60, 2)], "qid int, text string")
    whole = sorted(map(tuple, r.passages_in(chunks, passages).select("qid", "document_id").collect()))
    for name, value in (("QUERY_BLOCK", 20), ("BLOCK_CHARS", 200), ("QUERY_CHARS", 100)):
        monkeypatch.setattr(r, name, value)
    found = r.passages_in(chunks, passages)
    assert sorted(map(tuple, found.select("qid", "document_id").collect())) == whole == [(n, n) for n in range(0, 40, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(document_id" in plan and ", 4)" in plan  # by 740 characters, not by 40 rows


def test_chunking_bounds_its_batches(plain_session):
    from quern.operators.chunking import chunk_documents, chunk_pages

    docs = plain_session.createDataFrame([(1, [[("text", "some text", 0.0, 0.0, 0.0, 0.0)]])], f"document_id long, pages array<{pages.BLOCKS}>")
    assert chunk_documents(docs).first().content == "some text" and largest_batch(plain_session) < 16 << 20
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        plain_session.conf.unset(f"spark.sql.execution.arrow.{name}")
    plain = plain_session.createDataFrame([(1, 1, "some text")], "document_id long, page int, text string")
    assert chunk_pages(plain, keys=["document_id"]).first().content == "some text" and largest_batch(plain_session) < 16 << 20
