import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import near
from quern.llm.graph import components
from quern.llm.near import bands_for, forest, jaccard_links, ngram_jaccard_join, one_of_each

from .cases import empty, near_groups, odd, odd_rows, prose


def held(rows, texts, ids):
    root, links = near_groups(texts)
    return all((r.class_id, r.n_links) == (ids[root[ids.index(r.doc_id)]], links[ids.index(r.doc_id)]) for r in rows)


def family(m, seed=0, length=120):
    """Near copies of one text, each with its own changes, and strangers."""
    base = prose(seed, length).split(" ")
    out = []
    for k in range(m):
        w = list(base)
        for c in range(k % 6):
            w[(k * 37 + c * 23) % length] = f"x{k}y{c}"
        out.append(" ".join(w))
    return out + [prose(100 + k, 80) for k in range(10)]


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.9995), (0.5, 0.99), (0.95, 0.999), (1.0, 0.9)):
        b, r = bands_for(t, recall)
        assert 1 - (1 - t**r) ** b >= recall - 1e-12 and b * r <= 128
    assert bands_for(0.8, 0.9995) == (20, 5)


def test_links_of_a_family_are_all_found(spark):
    texts = family(60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ngram_jaccard_join(df).collect()
    assert len(rows) == len(texts) and held(rows, texts, list(range(len(texts))))


def test_large_families_are_dealt_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_CLASSES", 7)
    texts = family(40, seed=3)
    rows = ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert held(rows, texts, list(range(len(texts))))


def test_odd_rows(spark):
    rows = ngram_jaccard_join(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.class_id, r.n_links, r.n_copies))
    # three rows of one text and one of a null id: copies of each other, all near row 2
    assert got[0] == [(0, 4, 4)] * 2 and got[1] == [(0, 4, 4)] and got[2] == [(0, 4, 1)]
    assert got[3] == [(3, 0, 1)] and got[4] == [(4, 0, 1)] and got[5] == [(5, 0, 1)] and got[6] == [(6, 0, 1)]
    assert sorted(got[None], key=str) == [(0, 4, 4), (None, 0, 1)]
    assert ngram_jaccard_join(empty(spark)).collect() == []


def test_one_of_each_keeps_columns_and_one_row(spark):
    df = odd(spark)
    out = one_of_each(df)
    assert out.columns == df.columns and out.schema["text"].dataType == df.schema["text"].dataType
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [i for i in range(16) if i not in (1, 2)]
    assert one_of_each(empty(spark)).collect() == []


def test_ids_that_repeat_or_are_null(spark):
    texts = family(3, seed=9)[:3]
    clean, other, blank = prose(31, 70), prose(32, 70), " "
    rows = [(1, clean), (1, texts[1]), (1, other), (None, texts[0]), (None, texts[2]), (None, texts[2]), (None, blank), (1, None), (None, prose(33, 70)), (None, prose(33, 70))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, links = near_groups([t for _, t in rows])
    got = sorted(((r.doc_id, r.n_links) for r in ngram_jaccard_join(df).collect()), key=str)
    assert got == sorted(((i, n) for (i, _), n in zip(rows, links, strict=True)), key=str)
    kept = sorted(((r.doc_id, r.text) for r in one_of_each(df).collect()), key=str)
    assert kept == sorted([(1, clean), (1, other), (1, texts[1]), (None, blank), (1, None), (None, prose(33, 70))], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_matrix_products_count_shared_grams(seed):
    r = np.random.default_rng(seed)
    sets = [np.unique(r.integers(0, 30, r.integers(1, 25)).astype(np.uint64)) for _ in range(12)]
    link = jaccard_links(sets, 0.5)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert link[i, j] == (i != j and both / (len(a) + len(b) - both) >= 0.5)


@pytest.mark.parametrize("seed", range(8))
def test_forests_join_what_agrees_in_a_group(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 9, 30).tolist() + [70, 150]
    group = np.repeat(np.arange(len(sizes)), sizes)
    kinds = r.integers(0, 40, len(group))
    sketches = r.integers(0, 2, (41, 12)).astype(np.uint8)[kinds]
    block, across = r.integers(0, 2, len(group)), np.repeat(r.integers(0, 2, len(sizes)).astype(bool), sizes)
    label = forest(sketches, group, block, across, 10)
    root = list(range(len(group)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(group)):
        for j in range(i):
            if group[i] == group[j] and (sketches[i] == sketches[j]).sum() >= 10 and (not across[i] or block[i] != block[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert label.tolist() == [find(i) for i in range(len(group))]


def test_texts_of_one_template_make_no_family(spark, monkeypatch):
    """Half of each text is a template: pairs meet in bands at a similarity of about a third, and are no candidates."""
    template = prose(5, 150)
    texts = [template + " " + prose(700 + i, 150) for i in range(120)] + family(12, seed=4)
    compared = []
    written = near.cut

    def counted(df, name, *a):
        out = written(df, name, *a)
        if name == "families":
            compared.append(out.count())
        return out

    monkeypatch.setattr(near, "cut", counted)
    rows = ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert held(rows, texts, list(range(len(texts)))) and compared[0] <= 24


def test_large_buckets_are_dealt_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_BUCKET", 5)
    monkeypatch.setattr(near, "BUNDLE", 50)
    texts = family(40, seed=3)
    rows = ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert held(rows, texts, list(range(len(texts))))


def test_recall_of_links_on_a_table(spark):
    """All links of sf0.01 by comparing all pairs of its rows: as many are found as there are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    root, links = near_groups([texts[i] for i in ids])
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard_join(docs).collect()}
    assert sum(links) > 100 and got == {i: (ids[a], n) for i, a, n in zip(ids, root, links, strict=True)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    hub = spark.range(1, 500).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    assert components(hub).where("root = 0").count() == 500
