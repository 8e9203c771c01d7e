"""The engine: a store of documents and chunks with ingest, search, answers and evaluation over it."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import embed, formula_text, hashing_embedder
from ..functions.register import register
from ..functions.text import Segment, clean_latex, infer_title, is_blank, title_from_filename, tokens
from ..operators import documents as dml
from ..operators.answers import answer, contexts
from ..operators.chunking import assemble, chunk_documents
from ..operators.evaluation import retrieval_metrics, summary
from ..operators.pages import documents_of, extract_blocks, page_texts
from ..operators.retrieval import hybrid_search, rerank, stored_chunks, trigram_scorer
from ..session import ship
from ..sources.config import Config
from ..sources.pdf import parse_files, read_files
from ..sources.store import Store


@dataclass
class Question:
    """None stands for the default: hybrid on, rerank as configured."""

    query: str
    top_k: int = 0
    document_ids: list[str] = field(default_factory=list)
    hybrid: bool | None = None
    rerank: bool | None = None


@dataclass
class Progress:
    stage: str
    status: str
    ms: int = 0
    hits: int | None = None


class NotAllowed(PermissionError):
    pass


class NotFound(LookupError):
    pass


class Engine:
    """``embedder(texts)`` gives vectors, ``scorer(query, content)`` a relevance Column, ``generator(prompt,
    citations)`` an answer Column; the defaults need no service. ``formula_reader(region)`` gives the LaTeX of a formula by
    its document_id, page and box (a struct), null where it can't read it; ``segment`` cuts words (see ``tokens``)."""

    def __init__(
        self, spark: SparkSession, path: str, config: Config | None = None, *,
        embedder: Callable[[list[str]], list[list[float]]] | None = None, scorer: Callable[[Column, Column], Column] = trigram_scorer, generator=None,
        formula_reader: Callable[[Column], Column] | None = None, segment: Segment | None = None,
    ) -> None:
        ship(spark)
        register(spark)
        self.spark, self.config = spark, config or Config()
        self.store = Store(spark, path, {"documents": dml.DOCUMENTS, "chunks": dml.CHUNKS, "verdicts": dml.VERDICTS})
        self.embed = embed(embedder or hashing_embedder(self.config.ai.embedding.dimension), self.config.ai.embedding.batch_size)
        self.scorer, self.generator, self.formula_reader, self.segment = scorer, generator, formula_reader, segment

    # ------------------------------------------------------------ ingest

    def accept(self, files: DataFrame) -> DataFrame:
        """Verdicts for ``files`` (user_id, filename, content_hash, size_bytes, arrival; chunk_size and chunk_overlap if
        wished); new ones are pending documents afterwards."""
        rag = self.config.rag
        for name, default in (("chunk_size", rag.chunk_size), ("chunk_overlap", rag.chunk_overlap)):
            files = files.withColumn(name, F.coalesce(name, F.lit(default)) if name in files.columns else F.lit(default))
        documents = self.store.read("documents")
        fresh, verdicts = dml.accept(documents, files, max_mb=self.config.server.max_upload_size_mb)
        self.store.append({"verdicts": verdicts}, documents=fresh)
        return self.store.read("verdicts")

    def build(self, pages: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chunks, documents with their new state) of ``pages`` of glyphs (and title, error, where known)."""
        blocks = extract_blocks(pages)
        whole = documents_of(blocks).join(documents.select(F.col("id").alias("document_id"), "chunk_size", "chunk_overlap"), "document_id")
        cut = chunk_documents(whole)
        if self.formula_reader is not None:
            read = clean_latex(self.formula_reader(F.struct("document_id", "page", "left", "right", "top", "bot")))
            cut = cut.withColumn("content", F.when(F.col("kind") == "formula", formula_text(F.col("content"), read)).otherwise(F.col("content")))
        chunks = assemble(cut).withColumn("embedding", self.embed(F.col("content"))).withColumn("tokens", tokens(F.col("content"), self.segment))
        first = page_texts(blocks).where("page = 1").select("document_id", F.col("text").alias("_first"))
        info = pages.groupBy("document_id").agg(F.max("page").alias("_pages"), F.max("title").alias("_title"), F.max("error").alias("_error"))
        counts = cut.groupBy("document_id").agg(F.count("*").cast("int").alias("_chunks"))
        joined = documents.withColumnRenamed("id", "document_id").join(info, "document_id", "left").join(first, "document_id", "left").join(counts, "document_id", "left")
        error = F.coalesce("_error", F.when(F.col("_chunks").isNull(), F.lit("no text extracted")))
        title = infer_title(F.coalesce("_first", F.lit("")), F.coalesce("_title", F.lit("")))
        state = joined.withColumns(
            {
                "status": F.when(error.isNull(), F.lit("ready")).otherwise(F.lit("failed")), "error": error, "page_count": F.coalesce("_pages", F.lit(0)),
                "chunk_count": F.coalesce("_chunks", F.lit(0)), "title": F.when(is_blank(title), title_from_filename(F.col("filename"))).otherwise(title),
            }
        )
        return chunks.drop("kind", "left", "right", "top", "bot"), state.withColumnRenamed("document_id", "id").select(*documents.columns)

    def run(self, contents: DataFrame, n: int | None = None, parser=None) -> DataFrame:
        """Process pending documents, all or the ``n`` oldest, whose files ``contents`` (content_hash, content) holds.

        Chunks replace whatever the documents had; tables change together, so a failure leaves the old state.
        """
        documents = self.store.read("documents")
        _, claimed = dml.claim(documents, n)
        files = claimed.join(contents.select("content_hash", "content").dropDuplicates(["content_hash"]), "content_hash").select(F.col("id").alias("document_id"), "content")
        return self._replace(claimed, parse_files(files, **({"parser": parser} if parser else {})))

    def ingest_pages(self, documents_in: DataFrame, pages: DataFrame) -> DataFrame:
        """Store ``documents_in`` (as the documents table) with ``pages`` of glyphs."""
        ids = documents_in.select("id")
        self.store.change(ids, documents=lambda held: dml.upsert(held, documents_in))
        return self._replace(self.store.read("documents").join(ids, "id", "left_semi"), pages)

    def _replace(self, claimed: DataFrame, pages: DataFrame) -> DataFrame:
        for column in ("title", "error"):
            if column not in pages.columns:
                pages = pages.withColumn(column, F.lit(None).cast("string"))
        chunks, state = self.build(pages, claimed)
        ids = claimed.select("id")
        columns = self.store.schemas["chunks"].names
        self.store.change(ids, documents=lambda held: dml.upsert(held, state), chunks=lambda held: dml.delete_chunks(held, ids).unionByName(chunks.select(*columns)))
        return self.store.read("documents").join(ids, "id", "left_semi")

    def ingest_files(self, path: str, user: str) -> DataFrame:
        """Accept and process the files at ``path``; verdicts."""
        files = read_files(self.spark, path)
        verdicts = self.accept(files.select(F.lit(user).alias("user_id"), "filename", "content_hash", "size_bytes", F.concat_ws("|", "modified", "path").alias("arrival")))
        self.run(files)
        return verdicts

    def rechunk(self, document_id: str, user: str | None, contents: DataFrame, size: int | None = None, overlap: int | None = None) -> DataFrame:
        """Cut a document again, by the wish, else its own sizes, else the configured; failed documents can't be."""
        documents = self.store.read("documents")
        row = dml.get(documents, document_id, user).first()
        if row is None or row["status"] == "failed":
            raise NotFound(document_id)
        s, o = dml.resolve_chunking((self.config.rag.chunk_size, self.config.rag.chunk_overlap), (size, overlap), (row["chunk_size"] or None, row["chunk_overlap"]))
        one = documents.where(F.col("id") == document_id).withColumns({"chunk_size": F.lit(s), "chunk_overlap": F.lit(o)})
        files = one.join(contents.select("content_hash", "content"), "content_hash").select(F.col("id").alias("document_id"), "content")
        return self._replace(one, parse_files(files))

    # ------------------------------------------------------------ documents

    def scope(self, user: str) -> str:
        """Whose documents ``user`` may see: everyone's (empty) for administrators, else their own."""
        return "" if user in self.config.server.admin_users else user

    def get(self, document_id: str, user: str) -> DataFrame:
        found = dml.get(self.store.read("documents"), document_id, self.scope(user))
        if found.isEmpty():
            raise NotFound(document_id)
        return found

    def list(self, user: str) -> DataFrame:
        return dml.listing(self.store.read("documents"), self.scope(user))

    def delete(self, document_id: str, user: str) -> None:
        ids = self.spark.createDataFrame([(document_id,)], "id string")
        if dml.get(self.store.read("documents"), document_id, self.scope(user)).isEmpty():
            raise NotFound(document_id)
        self.store.change(ids, documents=lambda held: held.join(ids, "id", "left_anti"), chunks=lambda held: dml.delete_chunks(held, ids))

    def recover(self) -> int:
        """Documents left in processing are pending again; how many."""
        left = self.store.read("documents").where("status = 'processing'").select("id")
        n = left.count()
        if n:
            self.store.change(left, documents=lambda held: dml.reset_processing(held)[0])
        return n

    # ------------------------------------------------------------ search

    def chunks(self) -> DataFrame:
        return stored_chunks(self.store.read("chunks"), self.store.read("documents"))

    def wants_rerank(self, wish: bool | None) -> bool:
        known = bool(self.config.ai.rerank.model)
        return self.config.ai.rerank.enabled and known if wish is None else wish and known

    def search_batch(self, queries: DataFrame, *, top_k: int = 0, hybrid: bool | None = None, rerank_: bool | None = None, paths: Callable[[str, Exception], None] | None = None) -> DataFrame:
        """Hits of ``queries`` (qid, text; user_id, document_ids, embedding if there). All run in one plan; with ``paths``,
        as for single questions, a text path that fails is reported there and left out."""
        rag, settings = self.config.rag, self.config.ai.rerank
        k = top_k if top_k > 0 else rag.top_k
        again = self.wants_rerank(rerank_)
        pool = max(k, settings.candidate_pool) if again else k
        if "embedding" not in queries.columns:
            queries = queries.withColumn("embedding", self.embed(F.col("text")))
        hits = hybrid_search(self.chunks(), queries, pool, threshold=rag.similarity_threshold, hybrid=hybrid is not False, fusion=rag.fusion, coarse_limit=rag.coarse_limit, paths=paths, segment=self.segment)
        return rerank(hits, queries, k, scorer=self.scorer, top_n=settings.top_n) if again else hits

    def _batch(self, q: Question, user: str) -> DataFrame:
        return self.spark.createDataFrame([("q", q.query, self.scope(user), q.document_ids or None)], "qid string, text string, user_id string, document_ids array<string>")

    def _left_out(self, path: str, error: Exception) -> None:
        logging.getLogger(__name__).warning("the %s path is left out: %s: %s", path, type(error).__name__, error)

    def search(self, q: Question, user: str) -> DataFrame:
        return self.search_batch(self._batch(q, user), top_k=q.top_k, hybrid=q.hybrid, rerank_=q.rerank, paths=self._left_out).drop("qid").orderBy("rank")

    def search_events(self, q: Question, user: str) -> Iterator[tuple[str, object]]:
        """("progress", Progress) as each stage starts and is done, then ("result", rows) or ("error", message)."""
        try:
            for stage in ("embed", "retrieve", *(["rerank"] if self.wants_rerank(q.rerank) else [])):
                yield "progress", Progress(stage, "start")
                began, hits = time.perf_counter(), None
                if stage == "embed":
                    row = self._batch(q, user).withColumn("embedding", self.embed(F.col("text"))).collect()
                    batch = self.spark.createDataFrame(row, "qid string, text string, user_id string, document_ids array<string>, embedding array<float>")
                elif stage == "retrieve":
                    k = q.top_k if q.top_k > 0 else self.config.rag.top_k
                    pool = max(k, self.config.ai.rerank.candidate_pool) if self.wants_rerank(q.rerank) else k
                    found = self.search_batch(batch, top_k=pool, hybrid=q.hybrid, rerank_=False, paths=self._left_out)
                    rows, schema = found.collect(), found.schema
                    hits = len(rows)
                else:
                    rows = rerank(self.spark.createDataFrame(rows, schema), batch, k, scorer=self.scorer, top_n=self.config.ai.rerank.top_n).collect()
                yield "progress", Progress(stage, "done", int(1000 * (time.perf_counter() - began)), hits)
            yield "result", [r.asDict(recursive=True) for r in sorted(rows, key=lambda r: r["rank"])]
        except Exception as error:
            yield "error", str(error)

    def ask(self, q: Question, user: str) -> DataFrame:
        """An answer over all documents, for administrators only."""
        if user not in self.config.server.admin_users:
            raise NotAllowed(user)
        batch = self._batch(q, user)
        hits = self.search_batch(batch, top_k=q.top_k, hybrid=q.hybrid, rerank_=q.rerank, paths=self._left_out)
        extra = {"generator": self.generator} if self.generator else {}
        return answer(batch, hits, no_context=self.config.rag.no_context_reply, **extra)

    def context(self, q: Question, user: str) -> DataFrame:
        batch = self._batch(q, user)
        return contexts(batch, self.search_batch(batch, top_k=q.top_k, hybrid=q.hybrid, rerank_=q.rerank))

    def evaluate(self, queries: DataFrame, evidence: DataFrame, *keys: str, top_k: int = 10, cube: bool = False) -> DataFrame:
        """Mean retrieval metrics of ``queries`` (qid, text, expected_behavior and ``keys``) by ``keys``."""
        hits = self.search_batch(queries, top_k=top_k)
        return summary(retrieval_metrics(queries, evidence, hits), *keys, cube=cube)
