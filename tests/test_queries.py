import glob
import math
import os

import duckdb
import pytest

from quern.plans.queries import ORACLES, QUERIES, flagship

from .conftest import SF


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    found = db.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_layout_takes_all_words(spark, tmp_path):
    from quern.operators.layout import Glyphs
    from quern.operators.regions import page_blocks

    texts = {1: " ".join(f"w{i}" for i in range(700)), 2: "few words", 3: "", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, text in texts.items():
        ws = (text or "").split(" ")
        for n in range(0, len(ws), 240):
            glyphs = [{"font": "F1" if k % 3 else "F0", "font_size": 10.0, "x": 60.0 + k % 5 * 80, "y": 700.0 - k // 5 * 14, "w": len(w) * 5.0, "s": w} for k, w in enumerate(ws[n : n + 240])]
            content = "\n".join(b.row()["content"] for b in page_blocks(Glyphs.of(glyphs), [], set()))
            want.add((i, n // 240 + 1, "".join(content.split())))
    got = {(r.document_id, r.page, "".join(r.text.split())) for r in QUERIES["page_layout"](spark, str(tmp_path)).collect()}
    assert got == want and "w699" in "".join(t for _, _, t in got)


def test_gate_reads_all_documents(spark, tmp_path):
    texts = {i: f"{i} " + "word and more " * 100 for i in (3, 250, 9999)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["gate_states"](spark, str(tmp_path)).collect()
    assert sum(v for r in rows for v in r if isinstance(v, int)) == 3


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_nothing_else_imports_the_optional_subpackage():
    top = os.path.join(os.path.dirname(__file__), "..", "quern")
    for folder, _, names in os.walk(top):
        if "llm" not in folder.split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert ".llm" not in f.read(), name
