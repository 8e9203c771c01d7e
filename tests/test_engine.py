import pytest
from pyspark.sql import functions as F

from quern.__main__ import main
from quern.functions.text import normalize_text_py
from quern.operators.evaluation import span_p95
from quern.operators.layout import Glyphs
from quern.operators.pages import bad_fonts, extract_blocks, page_texts
from quern.operators.regions import page_blocks
from quern.plans.engine import Engine, NotAllowed, NotFound, Question
from quern.plans.spans import SpanLog
from quern.sources.config import Config, InvalidConfig, expand, load, load_dotenv
from quern.sources.pdf import parse_files, parse_pdf, trim_trailing_junk
from quern.streaming.ingest import file_stream, ingest_stream, span_windows

from .pdfs import FRAME, pdf, table, text


def blocks_of(data):
    page = parse_pdf(data).pages[0]
    return [(b.kind, b.content) for b in page_blocks(Glyphs.of(page.glyphs), [tuple(r.values()) for r in page.rects])]


def test_pdf_text_tables_and_junk():
    assert blocks_of(pdf(text(72, 700, "Hello"))) == [("text", "Hello")]
    assert blocks_of(pdf(FRAME + "\n" + table(100, 600, [["Name", "Qty"], ["Apple", "3"]]))) == [("table", "Name | Qty\nApple | 3")]
    two = blocks_of(pdf(FRAME + "\n" + table(100, 600, [["A", "B"], ["1", "2"]]) + table(100, 300, [["C", "D"], ["3", "4"]])))
    assert [b[1].split("\n")[0] for b in two] == ["A | B", "C | D"]
    junk = pdf(text(72, 700, "Hello"), trailer="<xml>after</xml>")
    assert trim_trailing_junk(junk).endswith(b"%%EOF") and blocks_of(junk) == [("text", "Hello")]
    assert trim_trailing_junk(b"none") == b"none"
    assert parse_pdf(pdf(text(72, 700, "x"), info="A title")).title == "A title"
    assert normalize_text_py("A\x00B\rC") == "AB\nC"
    with pytest.raises(ValueError, match="not a PDF"):
        parse_pdf(b"hello")


def test_pages_and_bad_fonts(spark):
    glyph = lambda font, s, x: {"font": font, "font_size": 10.0, "x": x, "y": 700.0, "w": 5.0, "s": s}
    rows = [("d", 1, [glyph("bad", "\x00", 10.0), glyph("bad", "x", 20.0), glyph("half", "�", 30.0), glyph("half", "y", 40.0), glyph("ok", "z", 50.0)], []), ("e", 1, None, None)]
    pages = spark.createDataFrame(rows, "document_id string, page int, glyphs array<struct<font: string, font_size: double, x: double, y: double, w: double, s: string>>, rects array<struct<x0: double, y0: double, x1: double, y1: double>>")
    assert [(r.document_id, r.font) for r in bad_fonts(pages).collect()] == [("d", "bad")]
    got = {r.document_id: r.text for r in page_texts(extract_blocks(pages)).collect()}
    assert got["e"] == "" and "x" not in got["d"] and "z" in got["d"]
    files = spark.createDataFrame([("a", bytearray(b"junk")), ("b", bytearray(pdf(text(72, 700, "Hi"))))], "document_id string, content binary")
    parsed = {r.document_id: (r.page, r.error) for r in parse_files(files).collect()}
    assert parsed["b"] == (1, None) and parsed["a"][0] == 0 and "not a PDF" in parsed["a"][1]


def files(spark, *rows):
    df = spark.createDataFrame([(u, n, bytearray(c), str(k)) for k, (u, n, c) in enumerate(rows)], "user_id string, filename string, content binary, arrival string")
    return df.withColumns({"content_hash": F.sha2("content", 256), "size_bytes": F.length("content").cast("bigint")})


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    config = Config()
    config.server.admin_users = ["admin"]
    config.ai.rerank.model = "offline"
    made = Engine(spark, str(tmp_path_factory.mktemp("store")), config)
    up = files(spark, ("u", "steel.pdf", pdf(text(72, 700, "Steel tubes carry load."))), ("v", "stone.pdf", pdf(text(72, 700, "Stone walls carry load."))), ("u", "empty.pdf", pdf("")), ("u", "again.pdf", pdf(text(72, 700, "Steel tubes carry load."))), ("u", "x.txt", b"x"))
    made.verdicts = {r.filename: r.status for r in made.accept(up.drop("content")).collect()}
    made.run(up)
    made.files = up
    return made


def test_ingest(engine):
    assert engine.verdicts == {"steel.pdf": "pending", "stone.pdf": "pending", "empty.pdf": "pending", "again.pdf": "duplicate", "x.txt": "failed"}
    state = {r.filename: (r.status, r.chunk_count, r.page_count, r.error) for r in engine.list("admin").collect()}
    assert state["steel.pdf"] == ("ready", 1, 1, "") and state["empty.pdf"][0] == "failed" and "no text" in state["empty.pdf"][3]
    assert {r.filename for r in engine.list("v").collect()} == {"stone.pdf"}
    assert engine.list("u").where("filename = 'steel.pdf'").first().title == "Steel tubes carry load."


def test_search_scope_and_events(engine):
    q = Question("carry load", top_k=5)
    assert {r.filename for r in engine.search(q, "u").collect()} == {"steel.pdf"}
    assert {r.filename for r in engine.search(q, "admin").collect()} == {"steel.pdf", "stone.pdf"}
    assert engine.search(Question("Steel", top_k=1, rerank=True), "admin").first().filename == "steel.pdf"
    events = list(engine.search_events(Question("Steel", rerank=True), "admin"))
    assert [(p.stage, p.status) for kind, p in events if kind == "progress"] == [(s, t) for s in ("embed", "retrieve", "rerank") for t in ("start", "done")]
    assert events[-1][0] == "result" and events[-1][1][0]["filename"] == "steel.pdf"
    assert engine.wants_rerank(None) is False and engine.wants_rerank(True) is True


def test_ask_is_for_administrators(engine):
    assert "[1]" in engine.ask(Question("Steel tubes"), "admin").first().answer
    with pytest.raises(NotAllowed):
        engine.ask(Question("Steel"), "u")


def test_rechunk_delete_and_recover(engine):
    doc = engine.list("u").where("filename = 'steel.pdf'").first()
    engine.rechunk(doc.id, "u", engine.files, size=10, overlap=2)
    assert engine.get(doc.id, "u").first().chunk_count > 1 and engine.store.read("chunks").where(F.col("document_id") == doc.id).count() == engine.get(doc.id, "u").first().chunk_count
    for call in (lambda: engine.get(doc.id, "v"), lambda: engine.delete(doc.id, "v"), lambda: engine.rechunk("nope", "u", engine.files)):
        with pytest.raises(NotFound):
            call()
    engine.delete(doc.id, "u")
    assert engine.store.read("chunks").where(F.col("document_id") == doc.id).isEmpty()
    assert engine.recover() == 0


def test_stream(spark, tmp_path):
    made, folder = Engine(spark, str(tmp_path / "store")), tmp_path / "in" / "u"
    folder.mkdir(parents=True)

    def run():
        ingest_stream(made, file_stream(spark, str(tmp_path / "in")), str(tmp_path / "check")).awaitTermination()

    (folder / "a.pdf").write_bytes(pdf(text(72, 700, "One file.")))
    (folder / "b.txt").write_bytes(b"no")
    run()
    assert [(r.filename, r.user_id, r.status) for r in made.list("").collect()] == [("a.pdf", "u", "ready")]
    (folder / "c.pdf").write_bytes(pdf(text(72, 700, "Another file.")))
    (folder / "copy.pdf").write_bytes(pdf(text(72, 700, "One file.")))
    run()
    run()
    assert sorted((r.filename, r.status) for r in made.list("").collect()) == [("a.pdf", "ready"), ("c.pdf", "ready")]
    assert made.store.read("chunks").count() == 2


def test_span_windows_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, 0), ("a", 3.0, 60), ("b", 5.0, 7200)], "event_type string, value double, s long").select("event_type", "value", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = span_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("spans").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.name, r.spans, r.mean_dur) for r in spark.table("spans").collect()} == {("a", 2, 2.0), ("b", 1, 5.0)} == {(r.name, r.spans, r.mean_dur) for r in span_windows(rows).collect()}


def test_config():
    env = {"A": "x"}
    assert expand("${A} ${B:-d} ${C}", env) == "x d ${C}"
    load_dotenv("# c\nexport K='v # w'\nN=10  # note\nA=other\nbad", env)
    assert env == {"A": "x", "K": "v # w", "N": "10"}
    c = load("rag: {chunk_size: 0, top_k: ${N}, chunk_overlap: 150}\nserver: {admin_users: [root], port: 1}", env)
    assert (c.rag.chunk_size, c.rag.top_k, c.rag.chunk_overlap, c.server.admin_users, c.ai.rerank.candidate_pool) == (800, 10, 150, ["root"], 30)
    with pytest.raises(InvalidConfig):
        load("rag: {chunk_size: 100, chunk_overlap: 100}")
    with pytest.raises(InvalidConfig):
        load("ai: {rerank: {enabled: true}}")


def test_spans(spark, tmp_path):
    log = SpanLog("run")
    with log.request("r1"), log.span("embed", n=2) as tags:
        tags["more"] = 1
    with pytest.raises(KeyError), log.span("bad"):
        raise KeyError("x")
    rows = {x.name: x for x in log.frame(spark).collect()}
    assert (rows["embed"].rid, rows["embed"].run_id, rows["embed"].ok, rows["embed"].tags) == ("r1", "run", True, {"n": "2", "more": "1"})
    assert not rows["bad"].ok and "KeyError" in rows["bad"].error and rows["bad"].rid == ""
    log.flush(spark, str(tmp_path / "spans"))
    assert log.rows == [] and span_p95(spark.read.parquet(str(tmp_path / "spans")), "run_id").count() == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(pdf(text(72, 700, "Steel tubes.")))
    base = ["--store", str(tmp_path / "store"), "--admin", "root"]
    assert main([*base, "--user", "u", "ingest", str(tmp_path / "in")], spark) == 0
    capsys.readouterr()
    assert main([*base, "--user", "u", "search", "Steel"], spark) == 0
    assert "a.pdf" in capsys.readouterr().out
    assert main([*base, "--user", "u", "ask", "Steel"], spark) == 2
    assert main([*base, "--user", "root", "ask", "Steel"], spark) == 0
    assert main([*base, "--user", "u", "delete", "nope"], spark) == 2
    assert main([*base, "--user", "u", "list"], spark) == 0


def test_evaluation_from_the_command_line(spark, tmp_path, capsys):
    import json

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "steel.pdf").write_bytes(pdf(text(72, 700, "Steel tubes carry 25 kN of load.")))
    out = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    run = lambda *a: main(["--store", str(tmp_path / "store"), "--user", "u", *a], spark)
    assert run("ingest", str(tmp_path / "in")) == 0
    ledger = {"docs": [{"doc_id": "D1", "filename": "steel.pdf", "title": "t", "pages": 1}, {"doc_id": "D2", "filename": "none.pdf"}]}
    facts = {"F1": {"doc": "D1", "page": 1, "quote": "tubes carry"}, "F2": {"doc": "D1", "page": 1, "quote": "no such words"}}
    evidence = [{"fact_id": "F1", "doc": "D1", "page": 1, "quote": "tubes carry", "role": "essential"}]
    queries = {"queries": [{"id": "q1", "retrieval_level": "R1", "question": "steel load", "expected_behavior": "answer", "evidence": evidence, "answer": {"type": "numeric", "value": 25, "unit": "kN", "tolerance": {"mode": "absolute", "value": 0.5}}}]}
    for name, data in (("ledger", ledger), ("facts", facts), ("queries", queries)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    (tmp_path / "answers.json").write_text('{"qid": "q1", "answer": "about 25.2 kN"}\n')
    out()
    assert run("gate", str(tmp_path / "ledger.json"), str(tmp_path / "facts.json")) == 0
    assert {(r.get("fact_id"), r["state"]) for r in out()} == {("F2", "MISSING"), (None, "OK"), (None, "MISSING")}
    assert run("evaluate", str(tmp_path / "ledger.json"), str(tmp_path / "queries.json"), "--out", str(tmp_path / "out")) == 0
    assert {r["page_recall"] for r in out()} == {1.0} and (tmp_path / "out" / "summary").is_dir()
    assert run("judge", str(tmp_path / "queries.json"), str(tmp_path / "answers.json")) == 0
    assert [r.get("verdict", r.get("answer_accuracy")) for r in out()] == ["correct", 1.0]


def test_formulas_are_read_and_a_failing_path_left_out(spark, tmp_path):
    def reader(region):
        return F.when(region["page"] == 1, F.concat(F.lit("$$x_"), region["page"].cast("string"), F.lit("$$")))

    made = Engine(spark, str(tmp_path / "s"), formula_reader=reader)
    glyph = lambda font, x, y, s: {"font": font, "font_size": 10.0, "x": x, "y": y, "w": 5.0 * len(s), "s": s}
    rows = [("d", p, [glyph("F1", 60.0, 720.0, "Some text here"), glyph("Cambria Math", 200.0, 650.0, f"x={p}")], []) for p in (1, 2)]
    pages = spark.createDataFrame(rows, "document_id string, page int, glyphs array<struct<font: string, font_size: double, x: double, y: double, w: double, s: string>>, rects array<struct<x0: double, y0: double, x1: double, y1: double>>")
    from quern.operators.documents import DOCUMENTS

    full = spark.createDataFrame([("d", "u", "d.pdf", "pending")], "id string, user_id string, filename string, status string")
    docs = full.select(*(F.col(f.name).cast(f.dataType) if f.name in full.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in DOCUMENTS))
    made.ingest_pages(docs, pages)
    assert sorted(r.content for r in made.store.read("chunks").collect()) == ["Some text here", "Some text here", "x=2", "x_1"]
    assert spark.sql("SELECT ts_rank_simple(array('A', 'b'), array('a'))").first()[0] > 0
