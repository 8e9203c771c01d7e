"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .bpe import bpe_round_trip, rank_file, split_pattern
from .common import shared_dir
from .huffman import read_ids, write_ids
from .language import identify
from .language import learn as learn_languages
from .licenses import license_scan
from .licenses import oracle as licenses_sql
from .mtree import top_k
from .near import ngram_jaccard_join
from .packing import pack
from .quality import LEAST_MEAN, MOST_DUP_LINES, MOST_MEAN, MOST_SYMBOLS, quality
from .substring import repeated_words
from .tokens import word_file
from .toxicity import in_fold, learn, toxicity

#: A document is toxic from this score on.
TOXIC = 0.7


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir), tokenizer=word_file())


def op2_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM (SELECT DISTINCT * FROM v) q JOIN v c ON c.vec_id <> q.vec_id AND q.vec_id % 50 = 0 AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_docs(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = learn_languages(docs.where(~in_fold("doc_id", 5, 0)))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels.where(~in_fold("doc_id", 3, 1)))
    scored = toxicity(docs, model).drop("text")
    return scored.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_docs(spark, sf_dir)).withColumn("notices", F.array_join("notices", ","))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/quern-ids-{uuid.uuid4().hex}"
    write_ids(_docs(spark, sf_dir), path, tokenizer=word_file())
    return read_ids(spark, path).drop("ids")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_docs(spark, sf_dir)).drop("rejected_by")


#: Which of several rules is asked first depends on measured times, so the query drops rejected_by.
OP8_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT rid, i, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM base)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT rid, sum(least(5, i + 5 - coalesce(e, 0))) AS n FROM (SELECT rid, i, lag(i + 5) OVER (PARTITION BY rid ORDER BY i) AS e FROM twice) GROUP BY rid
), counted AS (
  SELECT doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN repeats USING (rid)
), judged AS (
  SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols > word_chars * {MOST_SYMBOLS} OR len(ls) - len(list_distinct(ls)) > len(ls) * {MOST_DUP_LINES}
      OR word_chars < n_words * {LEAST_MEAN} OR word_chars > n_words * {MOST_MEAN} OR (upper(t) = t AND lower(t) <> t) AS rejected
  FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_docs(spark, sf_dir), ranks=rank_file(), pattern=split_pattern())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_mtree_top_k": op2_mtree_top_k,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_language_id": op4_language_id,
        "op5_toxicity": op5_toxicity,
        "op6_license_scan": op6_license_scan,
        "op7_token_files": op7_token_files,
        "op8_quality_rules": op8_quality_rules,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mtree_top_k": OP2_SQL, "op6_license_scan": licenses_sql(), "op8_quality_rules": OP8_SQL}
