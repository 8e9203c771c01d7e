"""Evaluation data as DataFrames with fixed schemas: ledgers of documents, facts and queries, and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = """docs array<struct<doc_id: string, filename: string, title: string, genre: string, language: string, layout: string, pages: int,
page_range: array<int>, has_text_layer: boolean, text_quality: string, has_table: boolean, has_formula: boolean, has_scan: boolean, license: string,
sha256: string, layer: string, slices: array<string>, status: string, notes: string>>"""
FACT = "struct<type: string, claim: string, doc: string, page: int, section: string, quote: string, latex: string, ref: string>"
QUERY = """struct<id: string, retrieval_level: string, answer_level: string, question: string, expected_behavior: string, status: string,
evidence: array<struct<fact_id: string, doc: string, page: int, quote: string, role: string>>, must_cite: array<string>,
answer: struct<type: string, value: variant, unit: string, tolerance: struct<mode: string, value: double>, keypoints: array<string>>,
forbidden_claims: array<string>, judge_rubric: array<string>, output_format: struct<unit_required: boolean>>"""


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path, multiLine=True).select(F.inline("docs"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts by id, from a file that maps ids to facts, at its top or under ``facts``."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.coalesce(F.from_json("value", f"facts map<string, {FACT}>")["facts"], F.from_json("value", f"map<string, {FACT}>"))).alias("fact_id", "f")).select("fact_id", "f.*")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries from a file that lists them under ``queries``."""
    text = spark.read.text(path, wholetext=True)
    flat = text.select(F.inline(F.from_json("value", f"queries array<{QUERY}>")["queries"]))
    answer = F.col("answer")
    return flat.withColumns(
        {
            "answer_type": answer["type"], "unit": answer["unit"], "has_tolerance": answer["tolerance"].isNotNull(), "keypoints": answer["keypoints"],
            "has_object_value": F.coalesce(F.schema_of_variant(answer["value"]).startswith("OBJECT"), F.lit(False)),
        }
    )


def evidence_of(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("id").alias("qid"), F.inline("evidence"))


def first_by_filename(ledger: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, document_id, matches): the stored document of each ledger row's file, the newest of several."""
    stored = documents.groupBy("filename").agg(F.max_by("id", F.struct("created_at", "id")).alias("document_id"), F.count("*").alias("matches"))
    return ledger.join(stored, "filename", "left").select("doc_id", "document_id", F.coalesce("matches", F.lit(0)).alias("matches"))


def write_results(summary: DataFrame, results: DataFrame, path: str) -> None:
    """Summary and results by query as JSON lines below ``path``."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    results.write.mode("overwrite").json(f"{path}/results")
