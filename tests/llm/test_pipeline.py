import re

from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm.common import cut
from quern.llm.queries import queries

from ..conftest import SF
from .cases import DOCS, empty, near_groups, odd, pruned


def test_every_number_has_its_query():
    names = queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names} == set(range(1, 11)) and len(names) == 10


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = cut(stage(spark, before, SF), "stage")
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        assert kept.columns == columns and 0 < kept.count() <= before.count(), name
        was, now = ({r.doc_id: r.text for r in x.collect()} for x in (before, kept))
        if name == "n-gram Jaccard join":
            ids = sorted(was)
            root, _ = near_groups([was[i] for i in ids])
            assert sorted(now) == sorted({ids[r] for r in root})
        elif name == "substring dedup":
            ids = sorted(was)
            for i, (n, gone, _) in zip(ids, pruned([was[i] for i in ids]), strict=True):
                assert (i not in now) if n and gone == n else len(now[i].split()) <= n and (gone > 0) == (now[i] != was[i])
        else:
            assert all(was[i] == t for i, t in now.items())
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect()}
    assert corpus_pipeline.run(spark, SF).count() == kept.count()


def test_stages_of_odd_and_empty_tables(spark, tmp_path):
    for table in (odd(spark), odd(spark, False).limit(0), spark.createDataFrame([(None,) * 5] * 3, DOCS)):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            kept = cut(stage(spark, kept, SF), "stage")
            assert name == corpus_pipeline.STAGES[-1][0] or kept.columns == table.columns
        assert kept.count() >= 0


def test_stages_keep_columns_of_their_own_names(spark):
    df = odd(spark).where("text is not null").select("doc_id", "text", F.lit("mine").alias("_toxicity"), F.lit("too").alias("_quern_score"))
    tame = corpus_pipeline.drop_toxic(spark, df, SF)
    assert tame.columns == df.columns and {(r[2], r[3]) for r in tame.collect()} == {("mine", "too")}
    assert corpus_pipeline.drop_repeated_passages(spark, df, SF).columns == df.columns  # without n_chars


def test_near_copies_of_an_empty_table(spark):
    assert cut(corpus_pipeline.drop_near_copies(spark, empty(spark), SF), "none").count() == 0
