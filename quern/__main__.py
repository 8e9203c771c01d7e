"""Command line over a store: ingest, list, search, ask, rechunk, delete, and evaluation: check its data, gate facts, run
queries, judge answers.

    python -m quern --store PATH --user NAME [--admin NAME]... COMMAND ...
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation
from .plans.engine import Engine, NotAllowed, NotFound, Question
from .sources import evaluation_data
from .sources.config import Config, load
from .sources.pdf import read_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description="A document store and its retrieval.")
    p.add_argument("--store", required=True)
    p.add_argument("--user", default="")
    p.add_argument("--admin", action="append", default=[])
    p.add_argument("--config")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("ingest").add_argument("path")
    c.add_parser("list")
    for name in ("search", "ask"):
        q = c.add_parser(name)
        q.add_argument("query")
        q.add_argument("--top-k", type=int, default=0)
        q.add_argument("--document", action="append", default=[])
        q.add_argument("--no-hybrid", action="store_true")
        q.add_argument("--rerank", action="store_true", default=None)
    r = c.add_parser("rechunk")
    r.add_argument("document")
    r.add_argument("path", help="where the document's file lies")
    r.add_argument("--size", type=int)
    r.add_argument("--overlap", type=int)
    c.add_parser("delete").add_argument("document")
    g = c.add_parser("check-queries", help="errors of queries and of their evidence")
    g.add_argument("queries")
    g.add_argument("facts")
    g = c.add_parser("gate", help="do chunks hold the facts' quotes?")
    g.add_argument("ledger")
    g.add_argument("facts")
    g = c.add_parser("evaluate", help="run queries; metrics by retrieval level")
    g.add_argument("ledger")
    g.add_argument("queries")
    g.add_argument("--top-k", type=int, default=10)
    g.add_argument("--out", help="write a summary and results below this path")
    g = c.add_parser("judge", help="verdicts on answers that a program can judge")
    g.add_argument("queries")
    g.add_argument("answers", help="JSON lines: qid, answer")
    return p


def stored_ids(engine: Engine, spark: SparkSession, ledger: str) -> DataFrame:
    """(doc, document_id): the stored documents of a ledger, by file name."""
    found = evaluation_data.first_by_filename(evaluation_data.read_ledger(spark, ledger), engine.store.read("documents"))
    return found.where("document_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "document_id")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    config = Config()
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            config = load(f.read())
    config.server.admin_users += a.admin
    engine = Engine(spark, a.store, config)
    show = lambda df: [print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str)) for r in df.toLocalIterator()]
    try:
        if a.command == "ingest":
            show(engine.ingest_files(a.path, a.user))
        elif a.command == "list":
            show(engine.list(a.user))
        elif a.command in ("search", "ask"):
            q = Question(a.query, a.top_k, a.document, hybrid=False if a.no_hybrid else None, rerank=a.rerank)
            show((engine.search if a.command == "search" else engine.ask)(q, a.user))
        elif a.command == "rechunk":
            show(engine.rechunk(a.document, engine.scope(a.user), read_files(spark, a.path), a.size, a.overlap))
        elif a.command == "delete":
            engine.delete(a.document, a.user)
        elif a.command == "gate":
            met = evaluation_data.read_facts(spark, a.facts).join(stored_ids(engine, spark, a.ledger), "doc")
            gated = evaluation.chunk_gate(met, engine.store.read("chunks"))
            show(gated.where("state <> 'OK'").orderBy("fact_id"))
            show(evaluation.gate_counts(gated))
        elif a.command == "evaluate":
            q = evaluation_data.read_queries(spark, a.queries)
            evidence = evaluation_data.evidence_of(q).join(stored_ids(engine, spark, a.ledger), "doc")
            asked = q.select(F.col("id").alias("qid"), F.col("question").alias("text"), "retrieval_level", "expected_behavior", F.lit(engine.scope(a.user)).alias("user_id"))
            measured = evaluation.retrieval_metrics(asked.drop("text", "user_id"), evidence, engine.search_batch(asked, top_k=a.top_k)).cache()
            summary = evaluation.summary(measured, "retrieval_level", cube=True)
            if a.out:
                evaluation_data.write_results(summary, measured, a.out)
            show(summary.orderBy("retrieval_level"))
        elif a.command == "judge":
            q = evaluation_data.read_queries(spark, a.queries)
            asked = q.select(F.col("id").alias("qid"), F.to_json(F.struct("question", "expected_behavior", "answer", "output_format", "forbidden_claims", "judge_rubric")).alias("question"))
            judged = evaluation.judge_answers(asked.join(spark.read.schema("qid string, answer string").json(a.answers), "qid")).cache()
            show(judged.orderBy("qid"))
            show(evaluation.correctness_summary(judged.join(q.select(F.col("id").alias("qid"), "expected_behavior"), "qid")))
        else:
            q = evaluation_data.read_queries(spark, a.queries)
            errors = evaluation.check_queries(q, evaluation_data.evidence_of(q), evaluation_data.read_facts(spark, a.facts)).collect()
            for e in errors:
                print(f"{e.place}: {e.message}")
            return int(bool(errors))
    except (NotAllowed, NotFound, ValueError) as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
