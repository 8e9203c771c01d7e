import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import similarity as sim
from quern.functions import text as tx
from quern.functions.models import embed, hash_vector, scorer
from quern.functions.register import register


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "int", list: None}
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values and all(v is not None and kinds[type(v)] for v in values.values()) else spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("r")).first().r


MESSY = ["a\r\nb\rc", "x\xa0y \n\n\n\n z", "\x00a\x00", "　 lead\n　trail　\n", "", "\n\n", "a\n \n \nb"]


@pytest.mark.parametrize("text", MESSY)
def test_normalizing_agrees_with_python(spark, text):
    assert one(spark, tx.normalize_text(F.col("t")), t=text) == tx.normalize_text_py(text)
    assert one(spark, tx.clean_text(F.col("t")), t=text) == tx.clean_text_py(text)


def test_cleaning():
    assert tx.clean_text_py("a�b\nc\rd\x00 ") == "abcd"
    assert tx.normalize_text_py("a \n\n\n b") == "a\n\nb"


def test_terms_and_tokens(spark):
    assert one(spark, tx.lex_terms(F.col("t")), t='V=0.5πtf\'Dcotθ 的 “钢管，混凝土”？ a ab') == ["V=0.5πtf'Dcotθ", "钢管", "混凝土", "ab"]
    assert one(spark, tx.plain_tokens(F.col("t")), t='say "hi"，二二') == ["say", '"hi"', "二二"]
    found = one(spark, tx.tokens(F.col("t")), t="钢管约束钢筋混凝土柱的受剪承载力 Hello, world. été 0.5 a x-y")
    assert {"钢管", "钢筋", "混凝", "凝土", "承载", "载力", "Hello", "world"} <= set(found)
    assert not {"été", "0.5", "a", "x-y"} & set(found)
    assert one(spark, tx.tokens(F.col("t")), t="  ") == []
    assert one(spark, tx.search_string(F.col("t")), t="ab cd") == "ab cd"


def test_titles_snippets_and_names(spark):
    assert one(spark, tx.snippet(F.col("t"), 3), t="一二三四") == "一二三..." and one(spark, tx.snippet(F.col("t"), 4), t="一二三四") == "一二三四"
    assert one(spark, tx.infer_title(F.col("t")), t="ab\n标题行\nmore") == "标题行"
    assert one(spark, tx.infer_title(F.col("t"), F.lit(" Info ")), t="first line") == "Info"
    assert one(spark, tx.infer_title(F.col("t"), F.lit(" ")), t="first line") == "first line"
    assert one(spark, tx.title_from_filename(F.col("t")), t="a.b.pdf") == "a.b"
    assert one(spark, tx.is_pdf(F.col("t")), t="A.PDF") and not one(spark, tx.is_pdf(F.col("t")), t="a.pdf.txt") and not one(spark, tx.is_pdf(F.col("t")), t="pdf")
    assert one(spark, tx.is_refusal(F.col("t")), t="抱歉") and not one(spark, tx.is_refusal(F.col("t")), t="ok")
    assert one(spark, tx.numbers(F.col("t")), t="1,234.5 and -7") == ["1234.5", "-7"]


def test_folding_quotes():
    assert tx.fold_quote_py("ＡＢ c-d — e～f �") == "ABcd-e~f" and tx.fold_quote_py("a�", False) == "a�"


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("$$x$$", "x"), ("\\[ a \\]", "a"), ("\\(a\\)", "a"), ("```latex\nx^2\n```", "x^2"), ("$$ $x$ $$", "x"), ("x \\leftarrow", "x"), ("a \\longrightarrow", "a"), ("$", ""), ("$$", ""), ("$$$", ""), ("", ""), ("x=1", "x=1")],
)
def test_clean_latex(raw, clean):
    assert tx.clean_latex_py(raw) == clean


def test_cosine(spark):
    c = sim.cosine_similarity(F.col("a"), F.col("b"))
    f = lambda a, b: spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(c).first()[0]
    assert f([1.0, 0.0], [0.0, 1.0]) == 0 and f([1.0, 2.0], [2.0, 4.0]) == pytest.approx(1)
    assert f([], []) == 0 and f([1.0], [1.0, 2.0]) == 0 and f([0.0], [1.0]) == 0 and f(None, [1.0]) == 0


def test_trigrams_and_rank(spark):
    assert one(spark, sim.trigram_similarity(F.col("a"), F.col("b")), a="word", b="two words") == pytest.approx(4 / 11)
    assert one(spark, sim.trigram_similarity(F.col("a"), F.col("b")), a="", b="") == 0
    rank = lambda tokens, q: spark.createDataFrame([(tokens, q)], "t array<string>, q array<string>").select(sim.ts_rank(sim.token_hits(F.col("t"), F.col("q")))).first()[0]
    assert rank(["a", "x"], ["a"]) == pytest.approx(0.0607927, abs=1e-6)
    assert rank(["a", "b"], ["a", "b"]) == pytest.approx(0.0991032, abs=1e-6)
    assert rank(["a"], ["b"]) == 0 and rank(["a"] * 2, ["a"]) == pytest.approx(0.0607927 * 1.25, abs=1e-6)


def test_registered_names(spark):
    register(spark)
    row = spark.sql("SELECT cosine_sim(array(1D, 0D), array(1D, 0D)) AS c, cosine_sim(array(0D), array(1D)) AS z, trgm_similarity('word', 'two words') AS t, rrf(1) AS r").first()
    assert row.c == 1 and row.z == 0 and row.t == pytest.approx(4 / 11) and row.r == pytest.approx(1 / 61)
    assert [r.content for r in spark.sql("SELECT * FROM split_text('one. two. three.', 6, 0)").collect()] == ["one. t", "wo. th", "ree."]


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=40))
def test_hash_vectors(text):
    v = hash_vector(text, 16)
    assert v == hash_vector(text, 16) and math.isclose(sum(x * x for x in v), 1, abs_tol=1e-5) or not any(v)


def test_embedding_in_batches_and_short_replies(spark):
    sizes = []
    df = spark.createDataFrame([(str(i),) for i in range(5)] + [(None,)], "t string").coalesce(1)
    rows = df.select(embed(lambda ts: [[float(len(ts))] for _ in ts], 4)("t").alias("v")).collect()
    sizes = [r.v[0] for r in rows]
    assert sizes == [4, 4, 4, 4, 2, 2]
    with pytest.raises(Exception, match="came back"):
        df.select(embed(lambda ts: [], 4)("t")).collect()


def test_a_failing_scorer_gives_nulls(spark):
    def model(query, contents):
        if query == "bad":
            raise RuntimeError
        return [float(len(c)) for c in contents]

    df = spark.createDataFrame([("q", "ab"), ("bad", "x")], "q string, c string")
    assert {r.q: r.s for r in df.select("q", scorer(model)(F.col("q"), F.col("c")).alias("s")).collect()} == {"q": 2.0, "bad": None}


def test_words_by_a_dictionary(spark):
    from quern.functions.segment import Dictionary, segmenter

    d = Dictionary.read(["钢管 50", "受剪 30", "承载力 40 n", "承载 20", "公式 10", "管受"])
    assert d.path("钢管受剪承载力公式") == ["钢管", "受剪", "承载力", "公式"] and d.path("钢铁") == ["钢", "铁"] and d.path("") == []
    assert d.words("cotθ, 钢管受剪承载力。x") == ["cotθ", "钢管", "受剪", "承载", "承载力", "x"]
    cut = segmenter(d)
    df = spark.createDataFrame([("钢管受剪承载力公式 cotθ",), ("plain words, here",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.tokens(F.col("t"), cut)).collect()]
    assert got == [["钢管", "受剪", "承载", "承载力", "公式", "cotθ"], ["plain", "words", "here"], [], []]
    assert got[1] == df.select(tx.tokens(F.col("t"))).collect()[1][0]


def test_places_that_count(spark):
    hits = [("b", 5), ("a", 3), ("a", 3), ("a", 99_999), ("a", 50_000)] + [("c", i) for i in range(400)]
    df = spark.createDataFrame([(hits,)], "h array<struct<t: string, p: int>>")
    kept = df.select(sim.counted_places(F.col("h"))).first()[0]
    assert [tuple(x) for x in kept] == [("a", 3), ("a", 16382), ("b", 5)] + [("c", i) for i in range(256)]


def test_rank_as_a_function_of_sql(spark):
    from quern.functions.register import register

    register(spark)
    texts = ["steel tube and Steel tube of steel", "tube", "none at all", "steel " * 300, ""]
    df = spark.createDataFrame([(t, w) for t in texts for w in (["steel", "tube"], ["steel"], [])], "t string, w array<string>").withColumn("ts", tx.tokens(F.col("t")))
    rows = df.select(F.expr("ts_rank_simple(ts, w)").alias("a"), sim.ts_rank(sim.token_hits(F.transform("ts", F.lower), F.col("w"))).alias("b")).collect()
    assert all(abs(r.a - r.b) < 1e-12 for r in rows) and max(r.a for r in rows) > 0


def test_event_streams():
    from quern.sources.events import decode, encode

    sent = [("progress", {"stage": "embed"}), ("result", [1, "ü\nx"]), ("error", "boom")]
    assert list(decode(encode(sent))) == sent
    assert list(decode([": hello", "data: a", "data: b", "", "id: 7", "event: x", "data:{}"])) == [("message", "a\nb"), ("x", {})]
    assert list(decode([])) == []
