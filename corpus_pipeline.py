"""Documents to packed training sequences, in stages that are each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept and returns the columns of
``documents``; the last returns the places of token pieces in sequences. Empty input is empty output everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, forget, free_name
from quern.llm.near import one_of_each
from quern.llm.packing import pack
from quern.llm.quality import keep_good
from quern.llm.queries import TOXIC
from quern.llm.substring import without_repeats
from quern.llm.tokens import word_file
from quern.llm.toxicity import in_fold, learn, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from ``labels`` scores below the threshold, their rows and columns as they are.

    Null, empty and blank texts hold nothing toxic and get the score of nothing; long texts are read whole, by their
    worst windows; equal texts get equal scores, so repeated rows stay or go together. Without labels of both classes all
    stay. Other columns may be null and have any names. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~in_fold("doc_id", 3, 1))
    score = free_name(docs, "_quern_score")
    scored = toxicity(docs, learn(docs, labels), score_col=score)
    return scored.where(F.col(score) < TOXIC).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, their rows and columns as they are.

    Null, empty and blank texts have no words and go; long texts are counted whole; repeated rows fare alike. Other columns
    may be null and have any names. An empty table stays empty.
    """
    return keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

    The row of the least id stays, null ids last, then that of the least digest of the text; of repeated rows one. Null,
    empty and blank texts are no one's copies and stay (rows without id and words all of them). Ids may be null or stand at
    several texts: a text is known by its digest. Other columns may have any names. An empty table stays empty.
    """
    return one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows of 35 that stand elsewhere too, all of them, the same text included; n_chars,
    where the table has it, follows the text.

    Texts that lose nothing stay as they are, null and blank ones too; documents that lose all words go, so of repeated
    rows, whose every window stands twice, none stays. Ids may be null or repeated. An empty table stays empty.
    """
    left = without_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id; only longer texts than a sequence are cut. Repeated rows are
    documents of their own; ids may be null. Other columns are ignored. An empty table gives no rows.
    """
    return pack(docs, tokenizer=word_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Learned scores, MinHash and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
