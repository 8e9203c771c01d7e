"""One query for each operator, over the driver's tables, and the SQL that gives the same rows where SQL can.

``documents`` stands for stored documents (owner: source) and, row by row, for chunks of one page; ``embeddings`` are
their vectors; benchmark passages are questions and quotes; events are spans.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import chunking, documents, evaluation, retrieval
from ..operators.answers import NO_CONTEXT, answer, contexts
from ..session import ship
from ..sources.evaluation_data import first_by_filename
from ..streaming.ingest import span_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Questions that stand for a batch: words of the tables' languages.
ASKED = ["the and of", "der die und", "de la que"]
SIZE, OVERLAP = 800, 150


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return f(spark, sf)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The documents table: states and times follow from ids."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        i.cast("string").alias("id"), F.col("source").alias("user_id"), F.concat(F.lit("doc-"), i.cast("string"), F.lit(".pdf")).alias("filename"), F.lit(None).cast("string").alias("title"),
        F.lit(1).alias("page_count"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.lit(1).alias("chunk_count"),
        F.when(i % 17 == 0, F.lit("failed")).when(i % 10 == 0, F.lit("pending")).when(i % 10 == 1, F.lit("processing")).otherwise(F.lit("ready")).alias("status"),
        F.lit(None).cast("string").alias("error"), F.sha2("text", 256).alias("content_hash"), F.lit(SIZE).alias("chunk_size"), F.lit(OVERLAP).alias("chunk_overlap"),
        F.lit(None).cast("timestamp").alias("updated_at"), F.timestamp_seconds(F.lit(1_700_000_000) + i).alias("created_at"),
    )


STORED_SQL = """stored AS (
  SELECT doc_id::VARCHAR AS id, source AS user_id, 'doc-' || doc_id || '.pdf' AS filename,
    CASE WHEN doc_id % 17 = 0 THEN 'failed' WHEN doc_id % 10 = 0 THEN 'pending' WHEN doc_id % 10 = 1 THEN 'processing' ELSE 'ready' END AS status,
    sha256(text) AS content_hash, 1700000000 + doc_id AS created, doc_id, text FROM documents
)"""


def chunks(spark: SparkSession, sf: str, vectors: bool = False) -> DataFrame:
    """Documents as chunks of one page each."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select(
        i.cast("string").alias("id"), i.alias("document_id"), F.col("source").alias("user_id"), F.concat(F.lit("doc-"), i.cast("string"), F.lit(".pdf")).alias("filename"),
        F.lit(1).alias("page"), F.lit(0).alias("idx"), F.col("text").alias("content"),
    )
    if not vectors:
        return d
    return d.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding", "label"), "document_id")


def asked(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({n}, '{q}')" for n, q in enumerate(ASKED, 1))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS q(qid, text)")


ASKED_SQL = "asked(qid, text) AS (VALUES " + ", ".join(f"({n}, '{q}')" for n, q in enumerate(ASKED, 1)) + ")"

# ---------------------------------------------------------------- vectors

VECTOR_SQL = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, source FROM embeddings JOIN documents ON vec_id = doc_id WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
scored AS (SELECT q.vec_id AS qid, c.vec_id AS document_id, round(list_cosine_similarity(q.e, c.e), 6) AS score, c.source, q.source AS asker FROM v q JOIN v c ON q.vec_id % 100 = 0)"""


def probes(spark: SparkSession, sf: str, scoped: bool = False) -> DataFrame:
    """The vectors of all rows whose id is divisible by 100, as questions."""
    q = chunks(spark, sf, vectors=True).where("document_id % 100 = 0")
    return q.select(F.col("document_id").alias("qid"), "embedding", *(["user_id"] if scoped else []))


def _vector_sql(where: str = "score >= 0", k: int = 10) -> str:
    return f"""WITH {VECTOR_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id)::INTEGER AS rank FROM scored WHERE {where})
SELECT qid, document_id, score, rank FROM ranked WHERE rank <= {k}"""


@query(f"WITH {VECTOR_SQL} SELECT document_id, score FROM scored WHERE qid = 0 AND score >= 0 ORDER BY score DESC, document_id LIMIT 10")
def vector_topk(spark, sf):
    q = probes(spark, sf).where("qid = 0")
    return retrieval.vector_search(chunks(spark, sf, True), q, 10).select("document_id", "score")


@query(_vector_sql())
def vector_topk_batch(spark, sf):
    return retrieval.vector_search(chunks(spark, sf, True), probes(spark, sf), 10).select("qid", "document_id", "score", "rank")


@query(_vector_sql("source = asker AND score >= 0"))
def vector_topk_filtered(spark, sf):
    return retrieval.vector_search(chunks(spark, sf, True), probes(spark, sf, True), 10).select("qid", "document_id", "score", "rank")


@query(_vector_sql("score >= 0.2"))
def threshold_search(spark, sf):
    return retrieval.vector_search(chunks(spark, sf, True), probes(spark, sf), 10, threshold=0.2).select("qid", "document_id", "score", "rank")


@query(f"""WITH {VECTOR_SQL}, coarse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id) AS c FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id)::INTEGER AS rank FROM coarse WHERE c <= 100 AND source = asker AND score >= 0)
SELECT qid, document_id, score, rank FROM ranked WHERE rank <= 5""")
def vector_coarse_late_filter(spark, sf):
    return retrieval.vector_search(chunks(spark, sf, True), probes(spark, sf, True), 5, coarse_limit=100).select("qid", "document_id", "score", "rank")


@query(f"""WITH {VECTOR_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id)::INTEGER AS rank FROM scored WHERE document_id BETWEEN qid + 1 AND qid + 30 AND score >= 0)
SELECT qid, document_id, score, rank FROM ranked WHERE rank <= 5""")
def vector_fill(spark, sf):
    """Questions about listed documents: what a coarse cut has lost of them is filled from these alone."""
    listed = probes(spark, sf).withColumn("document_ids", F.transform(F.sequence(F.col("qid") + 1, F.col("qid") + 30), lambda x: x.cast("string")))
    return retrieval.vector_search(chunks(spark, sf, True), listed, 5, coarse_limit=20).select("qid", "document_id", "score", "rank")


@query("""SELECT a.vec_id, round(CASE WHEN list_dot_product(a.embedding, a.embedding) > 0 THEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ELSE 0 END, 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2""")
def cosine_pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    other = e.select(F.col("vec_id").alias("half"), F.col("embedding").alias("other"))
    return e.join(other, F.floor(e.vec_id / 2) == other.half).select("vec_id", F.round(sim.cosine_similarity(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("""WITH wanted AS (SELECT item_id AS doc_id FROM benchmark) SELECT d.doc_id, d.source FROM documents d SEMI JOIN wanted USING (doc_id)""")
def doc_scope_semi_join(spark, sf):
    ids = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return table(spark, sf, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "source")


@query(f"WITH {STORED_SQL} SELECT id AS document_id, user_id, filename, length(text)::BIGINT AS chars FROM stored WHERE doc_id % 7 <> 0")
def chunks_joined(spark, sf):
    """Chunks with their documents' owner and file name; chunks of documents that are gone don't come."""
    held = chunks(spark, sf).drop("user_id", "filename").withColumn("document_id", F.col("document_id").cast("string"))
    met = retrieval.stored_chunks(held, stored(spark, sf).where(F.col("id").cast("bigint") % 7 != 0))
    return met.select("document_id", "user_id", "filename", F.length("content").cast("bigint").alias("chars"))


@query(f"WITH {STORED_SQL} SELECT user_id, count(*) AS documents FROM stored WHERE user_id = 'src3' GROUP BY user_id")
def tenant_scope(spark, sf):
    return stored(spark, sf).where(documents.scope("src3")).groupBy("user_id").agg(F.count("*").alias("documents"))


# ---------------------------------------------------------------- text paths

_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i::INTEGER, 3)))))"


def _grams(t: str) -> str:
    return _GRAMS.format(t=t)


_SIMILARITY = "len(list_intersect(dg, qg)) / (len(dg) + len(qg) - len(list_intersect(dg, qg)))"
LEXICAL_SQL = f"""d AS (SELECT doc_id, text, source, {_grams("text")} AS dg FROM documents), {ASKED_SQL},
q AS (SELECT qid, text, list_filter(string_split(text, ' '), lambda t: length(t) >= 2) AS terms, {_grams("text")} AS qg FROM asked),
lexical AS (SELECT qid, doc_id, round({_SIMILARITY}, 6) AS score FROM d JOIN q ON len(list_filter(terms, lambda t: d.text ILIKE '%' || t || '%')) > 0),
lex AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM lexical)"""


@query(f"WITH {LEXICAL_SQL} SELECT qid, doc_id AS document_id, score, rank FROM lex WHERE rank <= 25")
def trgm_similarity_topk(spark, sf):
    return retrieval.lexical_search(chunks(spark, sf), asked(spark), 25).select("qid", "document_id", "score", "rank")


@query(f"""WITH {ASKED_SQL}, q AS (SELECT qid, list_filter(string_split(text, ' '), lambda t: length(t) >= 2) AS terms FROM asked)
SELECT qid, count(*) AS documents FROM documents d JOIN q ON len(list_filter(terms, lambda t: d.text ILIKE '%' || t || '%')) > 0 GROUP BY qid""")
def lexical_ilike_or(spark, sf):
    q = asked(spark).select("qid", tx.lex_terms(F.col("text")).alias("terms"))
    d = table(spark, sf, "documents")
    return d.join(q, retrieval.any_term(d.text, q.terms)).groupBy("qid").agg(F.count("*").alias("documents"))


#: Questions with wildcards.
WILD = ["t_e%nd", "d%r_", "qu_ %zz"]
WILD_SQL = LEXICAL_SQL.replace(ASKED_SQL, "asked(qid, text) AS (VALUES " + ", ".join(f"({n}, '{q}')" for n, q in enumerate(WILD, 1)) + ")")


@query(f"WITH {WILD_SQL} SELECT qid, doc_id AS document_id, score, rank FROM lex WHERE rank <= 25")
def lexical_wildcards(spark, sf):
    q = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({n}, '{q}')" for n, q in enumerate(WILD, 1)) + " AS q(qid, text)")
    return retrieval.lexical_search(chunks(spark, sf), q, 25).select("qid", "document_id", "score", "rank")


_MARKS = ".,;:!?()\\[\\]{}\"“”，。？！；、：（）"
_TOKENS = f"list_filter(list_transform(regexp_extract_all(<t>, '[^\\s]+'), lambda w: regexp_replace(w, '^[{_MARKS}]+|[{_MARKS}]+$', '', 'g')), lambda w: length(w) >= 2 AND regexp_full_match(w, '[A-Za-z0-9''·θπαβγ]+'))"
FULLTEXT_SQL = f"""{ASKED_SQL}, tok AS (SELECT doc_id, list_transform({_TOKENS.replace("<t>", "text")}, lambda w: lower(w)) AS ts FROM documents),
every_place AS (SELECT DISTINCT doc_id, t, least(p, 16382) AS p FROM (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS p FROM tok)),
places AS (SELECT doc_id, t, p FROM every_place WHERE t IN (SELECT unnest(string_split(text, ' ')) FROM asked) QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY p) <= 256), terms AS (SELECT DISTINCT qid, unnest(string_split(text, ' ')) AS t FROM asked),
many AS (SELECT qid, count(*) AS n FROM terms GROUP BY qid), hits AS (SELECT qid, doc_id, t, p FROM places JOIN terms USING (t)),
matched AS (SELECT qid, doc_id FROM hits JOIN many USING (qid) GROUP BY qid, doc_id, n HAVING count(DISTINCT t) = n),
pairs AS (SELECT a.qid, a.doc_id, sum(ln(1 - sqrt(0.01 * CASE WHEN abs(a.p - b.p) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.p - b.p) / 1.5 - 2)) END))) AS s
  FROM hits a JOIN hits b ON a.qid = b.qid AND a.doc_id = b.doc_id AND a.t < b.t GROUP BY a.qid, a.doc_id),
fulltext AS (SELECT qid, doc_id, round(1 - exp(s), 6) AS score FROM matched JOIN pairs USING (qid, doc_id)),
full_ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM fulltext)"""


@query(f"WITH {FULLTEXT_SQL} SELECT qid, count(*) AS documents FROM matched GROUP BY qid")
def fulltext_and_match(spark, sf):
    return retrieval.fulltext_search(chunks(spark, sf), asked(spark), 1 << 30).groupBy("qid").agg(F.count("*").alias("documents"))


@query(f"WITH {FULLTEXT_SQL} SELECT qid, doc_id AS document_id, score, rank FROM full_ranked WHERE rank <= 25")
def ts_rank_topk(spark, sf):
    return retrieval.fulltext_search(chunks(spark, sf), asked(spark), 25).select("qid", "document_id", "score", "rank")


@query(f"""WITH tok AS (SELECT doc_id, len(list_filter({_TOKENS.replace("<t>", "text")}, lambda w: lower(w) = 'the')) AS tf FROM documents)
SELECT doc_id AS document_id, round(list_sum(list_transform(range(1, least(tf, 256) + 1), lambda j: 1.0 / (j * j))) * 0.1 / 1.64493406685, 6) AS score FROM tok WHERE tf > 0""")
def ts_rank_single(spark, sf):
    return retrieval.fulltext_match(chunks(spark, sf), "the").select("document_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- fusion

_RRF = """m AS (SELECT qid, doc_id, round(sum(vote), 9) AS score FROM (SELECT qid, doc_id, 1.0 / (60 + rank) AS vote FROM a UNION ALL SELECT qid, doc_id, 1.0 / (60 + rank) FROM b) GROUP BY qid, doc_id),
merged AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM m)"""


@query(f"WITH {LEXICAL_SQL}, {FULLTEXT_SQL.removeprefix(ASKED_SQL + ', ')}, a AS (SELECT * FROM full_ranked WHERE rank <= 25), b AS (SELECT * FROM lex WHERE rank <= 25), {_RRF} SELECT qid, doc_id AS document_id, score, rank FROM merged WHERE rank <= 10")
def rrf_two_way(spark, sf):
    c, q = chunks(spark, sf), asked(spark)
    return retrieval.rrf_merge([retrieval.fulltext_search(c, q, 25), retrieval.lexical_search(c, q, 25)], 10).select("qid", "document_id", "score", "rank")


#: A question of a batch has the vector of the row of its number.
_HYBRID = f"""WITH {LEXICAL_SQL}, {FULLTEXT_SQL.removeprefix(ASKED_SQL + ", ")},
vs AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings JOIN documents ON vec_id = doc_id WHERE list_dot_product(embedding, embedding) > 0),
vec AS (SELECT qid, c.vec_id AS doc_id, round(list_cosine_similarity(p.e, c.e), 6) AS score FROM asked JOIN vs p ON p.vec_id = qid JOIN vs c ON TRUE),
v AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM vec WHERE score >= 0)"""
_NESTED = (
    _HYBRID
    + """, one AS (SELECT qid, doc_id, round(sum(vote), 9) AS score FROM (SELECT qid, doc_id, 1.0 / (60 + rank) AS vote FROM v WHERE rank <= 10 UNION ALL SELECT qid, doc_id, 1.0 / (60 + rank) FROM full_ranked WHERE rank <= 50) GROUP BY qid, doc_id),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM one) WHERE rank <= 10), b AS (SELECT * FROM lex WHERE rank <= 50), """
    + _RRF
)


def _hybrid(spark, sf, **how):
    c = chunks(spark, sf)
    vectors = chunks(spark, sf, True).select(*retrieval.KEY, "user_id", "embedding")
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("qid"), "embedding")
    return retrieval.hybrid_search(c, asked(spark).join(v, "qid"), 10, vectors=vectors, **how)


@query(_NESTED + " SELECT qid, doc_id AS document_id, score, rank FROM merged WHERE rank <= 10")
def rrf_nested(spark, sf):
    return _hybrid(spark, sf).select("qid", "document_id", "score", "rank")


@query(
    _HYBRID
    + """, m AS (SELECT qid, doc_id, round(sum(vote), 9) AS score FROM (SELECT qid, doc_id, 1.0 / (60 + rank) AS vote FROM v WHERE rank <= 10 UNION ALL SELECT qid, doc_id, 1.0 / (60 + rank) FROM full_ranked WHERE rank <= 50
  UNION ALL SELECT qid, doc_id, 1.0 / (60 + rank) FROM lex WHERE rank <= 50) GROUP BY qid, doc_id),
merged AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM m) SELECT qid, doc_id AS document_id, score, rank FROM merged WHERE rank <= 10"""
)
def rrf_flat(spark, sf):
    return _hybrid(spark, sf, fusion="flat").select("qid", "document_id", "score", "rank")


@query(_NESTED + " SELECT qid, doc_id::VARCHAR AS id, source AS user_id, 'doc-' || doc_id || '.pdf' AS filename, length(text) AS chars, score, 'rrf' AS score_kind, rank FROM merged JOIN documents USING (doc_id) WHERE rank <= 10")
def hybrid_search(spark, sf):
    return _hybrid(spark, sf).select("qid", "id", "user_id", "filename", F.length("content").cast("bigint").alias("chars"), "score", "score_kind", "rank")


@query(
    _NESTED
    + f""", found AS (SELECT merged.qid, doc_id, round({_SIMILARITY}, 6) AS relevance FROM merged JOIN d USING (doc_id) JOIN q ON q.qid = merged.qid WHERE rank <= 10),
again AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, doc_id)::INTEGER AS rank FROM found) SELECT qid, doc_id AS document_id, relevance AS score, rank FROM again WHERE rank <= 5"""
)
def rerank_truncate(spark, sf):
    return retrieval.rerank(_hybrid(spark, sf), asked(spark), 5).select("qid", "document_id", "score", "rank")


@query(
    f"""WITH {LEXICAL_SQL}, hits AS (SELECT qid, rank, doc_id, trim(text, ' ' || chr(10)) AS t FROM lex JOIN documents USING (doc_id) WHERE rank <= 5)
SELECT qid, count(*) AS hits, string_agg('[' || rank || '] (来源: doc-' || doc_id || '.pdf, 第 1 页)' || chr(10) || t || chr(10) || chr(10), '' ORDER BY rank) AS context FROM hits GROUP BY qid"""
)
def context_build(spark, sf):
    hits = retrieval.lexical_search(chunks(spark, sf), asked(spark), 5).join(chunks(spark, sf), retrieval.KEY)
    return contexts(asked(spark), hits).select("qid", "hits", "context")


@query(_vector_sql().replace("SELECT qid, document_id, score, rank FROM", "SELECT qid, document_id, score, rank, 'cosine' AS score_kind FROM"))
def hybrid_gate(spark, sf):
    """Questions without a word are searched by vector alone."""
    blank = probes(spark, sf).withColumn("text", F.when(F.col("qid") % 200 == 0, F.lit("  ")))
    found = retrieval.hybrid_search(chunks(spark, sf, True), blank, 10)
    return found.select("qid", "document_id", F.col("score"), "rank", "score_kind")


_POOL_SQL = """pool AS (SELECT doc_id // 40 AS qid, doc_id AS document_id, doc_id % 40 + 1 AS rank, text, length(text) AS n, 1.0 / (doc_id % 40 + 1) AS score FROM documents)"""


def _pool(spark, sf):
    """Hits of a search before a rerank: 40 documents to a question."""
    i = F.col("document_id")
    return chunks(spark, sf).withColumn("qid", F.floor(i / 40)).withColumn("rank", (i % 40 + 1).cast("int")).withColumns({"score": 1.0 / F.col("rank"), "score_kind": F.lit("rrf")})


@query(f"""WITH {_POOL_SQL}, scored AS (SELECT *, CASE WHEN qid % 3 = 0 OR n % 4 = 0 THEN NULL ELSE round(1000.0 / (1 + n), 6) END AS s, count(*) OVER (PARTITION BY qid) AS hits FROM pool),
judged AS (SELECT *, hits > 5 AND count(s) OVER (PARTITION BY qid) > 0 AS again FROM scored),
kept AS (SELECT qid, document_id, again, CASE WHEN again THEN s ELSE score END AS score, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN again THEN -s ELSE rank END, document_id)::INTEGER AS rank FROM judged WHERE NOT again OR s IS NOT NULL)
SELECT qid, document_id, round(score, 6) AS score, CASE WHEN again THEN 'rerank' ELSE 'rrf' END AS score_kind, rank FROM kept WHERE rank <= CASE WHEN again THEN 3 ELSE 5 END""")
def rerank_pool(spark, sf):
    """A rerank of larger pools to 3 of 5; hits without a score drop, and a question without any keeps its order."""
    size = F.length("content")

    def scorer(query, content):
        return F.when((F.col("qid") % 3 != 0) & (F.length(content) % 4 != 0), F.round(1000.0 / (1 + F.length(content)), 6))

    hits = _pool(spark, sf).withColumn("chars", size)
    questions = hits.select("qid", F.lit("?").alias("text")).distinct()
    return retrieval.rerank(hits, questions, 5, scorer=scorer, top_n=3).select("qid", "document_id", F.round("score", 6).alias("score"), "score_kind", "rank")


@query(f"""WITH {_POOL_SQL}, answers AS (SELECT qid, rank, CASE WHEN qid % 4 <> 1 AND document_id % 3 = 0 THEN round((document_id * 7 % 101) / 101.0, 6) END AS s, document_id, score FROM pool),
judged AS (SELECT *, count(s) OVER (PARTITION BY qid) > 0 AS again FROM answers),
kept AS (SELECT qid, document_id, CASE WHEN again THEN s ELSE score END AS score, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN again THEN -s ELSE rank END, document_id)::INTEGER AS rank FROM judged WHERE NOT again OR s IS NOT NULL)
SELECT qid, document_id, round(score, 6) AS score, rank FROM kept WHERE rank <= 4""")
def rerank_positions(spark, sf):
    """Replies of a rerank service by position; some name none of the hits, some questions have no reply."""
    hits = _pool(spark, sf)
    replied = hits.where("qid % 4 <> 1 AND document_id % 3 = 0").select("qid", (F.col("rank") - 1).alias("index"), F.round((F.col("document_id") * 7 % 101) / 101.0, 6).alias("relevance_score"))
    beyond = replied.withColumn("index", F.col("index") + 1000)
    return retrieval.rerank_positions(hits, replied.unionByName(beyond), 4).select("qid", "document_id", F.round("score", 6).alias("score"), "rank")


@query(f"""SELECT item_id AS qid, CASE WHEN d.doc_id IS NULL THEN '{NO_CONTEXT}' ELSE trim(CASE WHEN length(t) > 200 THEN substring(t, 1, 200) || '...' ELSE t END || ' [1]') END AS answer, (d.doc_id IS NOT NULL)::BIGINT AS total_chunks
FROM benchmark LEFT JOIN (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE doc_id % 2 = 0) d ON d.doc_id = item_id""")
def answers_or_none(spark, sf):
    """An answer from the best source, and a fixed reply, without asking a model, where nothing was found."""
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    found = chunks(spark, sf).where("document_id % 2 = 0").withColumns({"qid": F.col("document_id"), "rank": F.lit(1), "score": F.lit(1.0)})
    return answer(questions, found.join(questions.select("qid"), "qid", "left_semi")).select("qid", "answer", "total_chunks")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS snippet FROM documents")
def snippet_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


# ---------------------------------------------------------------- documents


UPLOADS_SQL = f"""{STORED_SQL}, files AS (SELECT doc_id, user_id, content_hash, doc_id % 11 = 0 OR doc_id % 13 = 0 AS bad FROM stored),
live AS (SELECT DISTINCT user_id, content_hash, true AS known FROM stored WHERE doc_id % 3 = 0 AND status <> 'failed'),
verdicts AS (SELECT user_id, content_hash, doc_id, CASE WHEN bad THEN 'failed' WHEN known OR row_number() OVER (PARTITION BY user_id, content_hash, bad ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'pending' END AS status
  FROM files LEFT JOIN live USING (user_id, content_hash))"""


def uploads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(documents that are there, files that come): a third are stored, all come (again), some of a wrong type or too large."""
    i = F.col("doc_id")
    files = table(spark, sf, "documents").select(
        F.col("source").alias("user_id"), F.concat(F.lit("doc-"), i, F.when(i % 11 == 0, F.lit(".txt")).otherwise(F.lit(".PDF"))).alias("filename"), F.sha2("text", 256).alias("content_hash"),
        F.when(i % 13 == 0, F.lit(21 << 20)).otherwise(F.octet_length("text")).alias("size_bytes"), i.alias("arrival"), F.lit(SIZE).alias("chunk_size"), F.lit(OVERLAP).alias("chunk_overlap"),
    )
    return stored(spark, sf).where(F.col("id").cast("bigint") % 3 == 0), files


@query(f"WITH {UPLOADS_SQL} SELECT user_id, content_hash, doc_id AS arrival, status FROM verdicts")
def dedup_by_owner_hash(spark, sf):
    old, files = uploads(spark, sf)
    _, verdicts = documents.accept(old, files)
    return verdicts.join(files.select("arrival", "content_hash"), "arrival").select("user_id", "content_hash", "arrival", "status")


@query(f"WITH {UPLOADS_SQL} SELECT user_id, count(*) AS total, count(*) FILTER (status <> 'failed') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'duplicate') AS duplicate FROM verdicts GROUP BY user_id")
def upload_counts(spark, sf):
    return documents.upload_summary(documents.accept(*uploads(spark, sf))[1], "user_id")


@query(f"WITH {STORED_SQL} SELECT CASE WHEN user_id = 'src1' THEN 'admin' ELSE user_id END AS user_id, count(*) AS documents FROM stored GROUP BY 1")
def owner_migration(spark, sf):
    return documents.migrate_owner(stored(spark, sf), "src1", "admin").groupBy("user_id").agg(F.count("*").alias("documents"))


@query(f"""WITH {STORED_SQL} SELECT id, user_id, CASE WHEN doc_id % 3 = 0 THEN 'new' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'ready' ELSE status END AS status, content_hash, created, CASE WHEN doc_id % 3 = 0 THEN 1800000000::BIGINT END AS updated FROM stored
UNION ALL SELECT 'n' || id, 'someone', 'new', 'ready', 'h', 0, NULL FROM stored WHERE doc_id % 3 = 0""")
def doc_upsert(spark, sf):
    old = stored(spark, sf)
    third = old.where(F.col("id").cast("bigint") % 3 == 0)
    changed = third.withColumns({"title": F.lit("new"), "status": F.lit("ready"), "user_id": F.lit("someone"), "content_hash": F.lit("h"), "created_at": F.timestamp_seconds(F.lit(0))})
    saved = changed.unionByName(changed.withColumn("id", F.concat(F.lit("n"), "id")))
    out = documents.upsert(old, saved, now=F.timestamp_seconds(F.lit(1_800_000_000)))
    return out.select("id", "user_id", "title", "status", "content_hash", F.unix_timestamp("created_at").alias("created"), F.unix_timestamp("updated_at").alias("updated"))


@query(f"WITH {STORED_SQL} SELECT user_id, count(*) AS documents, sum(length(text))::BIGINT AS chunk_chars FROM stored WHERE NOT (user_id = 'src1' AND doc_id % 2 = 1) GROUP BY user_id")
def delete_cascade(spark, sf):
    ids = stored(spark, sf).where(F.col("id").cast("bigint") % 2 == 1).select("id")
    held = chunks(spark, sf).withColumn("document_id", F.col("document_id").cast("string"))
    left, chunks_left, _ = documents.delete(stored(spark, sf), held, ids, "src1")
    chars = chunks_left.groupBy("user_id").agg(F.sum(F.length("content")).alias("chunk_chars"))
    return left.groupBy("user_id").agg(F.count("*").alias("documents")).join(chars, "user_id")


@query(f"WITH {STORED_SQL}, t AS (SELECT id FROM stored WHERE status = 'pending' ORDER BY created, id LIMIT 7) SELECT CASE WHEN t.id IS NULL THEN status ELSE 'claimed' END AS status, count(*) AS documents FROM stored LEFT JOIN t USING (id) GROUP BY 1")
def claim_oldest(spark, sf):
    after, taken = documents.claim(stored(spark, sf), 7)
    marked = after.join(taken.select("id", F.lit(True).alias("t")), "id", "left")
    return marked.groupBy(F.when(F.col("t"), F.lit("claimed")).otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("documents"))


@query(f"WITH {STORED_SQL} SELECT CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status, count(*) AS documents FROM stored GROUP BY 1")
def reset_processing(spark, sf):
    return documents.reset_processing(stored(spark, sf))[0].groupBy("status").agg(F.count("*").alias("documents"))


@query(f"WITH {STORED_SQL} SELECT id, filename, '' AS title, status, '' AS error, created FROM stored WHERE user_id = 'src2'")
def list_docs(spark, sf):
    return documents.listing(stored(spark, sf), "src2").select("id", "filename", "title", "status", "error", F.unix_timestamp("created_at").alias("created"))


@query(f"WITH {STORED_SQL} SELECT id, filename FROM stored WHERE id = '7' AND user_id = 'src7'")
def get_doc(spark, sf):
    return documents.get(stored(spark, sf), "7", "src7").select("id", "filename")


@query(f"WITH {STORED_SQL}, w AS (SELECT content_hash, user_id FROM stored WHERE doc_id = 2) SELECT id, status FROM stored JOIN w USING (content_hash, user_id) ORDER BY status = 'failed', created, id LIMIT 1")
def find_by_hash(spark, sf):
    d = stored(spark, sf)
    two = d.where("id = '2'").select("content_hash", "user_id")
    return d.join(two, ["content_hash", "user_id"], "left_semi").orderBy(F.col("status") == "failed", "created_at", "id").limit(1).select("id", "status")


@query(f"WITH {STORED_SQL} SELECT CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN doc_id % 5 = 0 THEN 'no text' END AS error, count(*) AS documents FROM stored GROUP BY ALL")
def fail_docs(spark, sf):
    d = stored(spark, sf)
    errors = d.where(F.col("id").cast("bigint") % 5 == 0).select("id", F.lit("no text").alias("message"))
    return documents.fail(d, errors).groupBy("status", "error").agg(F.count("*").alias("documents"))


# ---------------------------------------------------------------- chunking and text


CHUNKS_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t FROM documents),
w(doc_id, t, pos, start, cut) AS (
  SELECT doc_id, t, 0, 0, 0 FROM d WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, pos + 1, nxt, CASE WHEN nxt + {SIZE} >= length(t) THEN length(t) ELSE nxt + {SIZE} - (CASE WHEN b > 0 AND b <= {SIZE // 3} THEN b - 1 ELSE 0 END) END
  FROM (SELECT doc_id, t, pos, nxt, strpos(regexp_replace(reverse(substring(t, nxt + {SIZE} - {SIZE // 3} + 1, {SIZE // 3})), '[\\n。！？.!?；;]', chr(1)), chr(1)) AS b
    FROM (SELECT doc_id, t, pos, CASE WHEN pos = 0 THEN 0 ELSE greatest(cut - {OVERLAP}, start + 1) END AS nxt FROM w WHERE pos = 0 OR cut < length(t)))
), pieces AS (SELECT doc_id AS document_id, pos - 1 AS pos, substring(t, start + 1, cut - start) AS content FROM w WHERE pos > 0 AND length(trim(substring(t, start + 1, cut - start), ' ' || chr(10))) > 0)"""


@query(CHUNKS_SQL + " SELECT document_id, pos, content FROM pieces")
def chunk_fixed_window(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")
    return chunking.chunk_pages(pages, keys=["document_id"], size=SIZE, overlap=OVERLAP).select("document_id", "pos", "content")


@query(CHUNKS_SQL + " SELECT lang, count(*) AS chunks, count(DISTINCT document_id) AS documents, max(length(content))::INTEGER AS longest FROM pieces JOIN documents ON doc_id = document_id GROUP BY lang")
def chunk_stats(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text", "lang")
    cut = chunking.chunk_pages(pages, keys=["document_id", "lang"], size=SIZE, overlap=OVERLAP)
    return cut.groupBy("lang").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.max(F.length("content")).alias("longest"))


_BY_SIZE_SQL = (
    CHUNKS_SQL.replace("SELECT doc_id, regexp_replace(regexp", "SELECT doc_id, 200 + doc_id % 5 * 100 AS sz, doc_id % 3 * 40 AS ov, regexp_replace(regexp").replace("w(doc_id, t,", "w(doc_id, sz, ov, t,").replace("SELECT doc_id, t, ", "SELECT doc_id, sz, ov, t, ")
    .replace(f"{SIZE // 3}", "(sz // 3)").replace(f"{SIZE}", "sz").replace(f"cut - {OVERLAP}", "cut - ov")
)


@query(_BY_SIZE_SQL + " SELECT document_id, pos::INTEGER AS idx, 1 AS page, 'text' AS kind, content FROM pieces")
def chunk_documents_by_size(spark, sf):
    """Documents cut again, each by sizes of its own."""
    i = F.col("doc_id")
    block = F.struct(F.lit("text").alias("kind"), F.col("text").alias("content"), *(F.lit(0.0).alias(c) for c in ("left", "right", "top", "bot")))
    docs = table(spark, sf, "documents").select(i.alias("document_id"), F.array(F.array(block)).alias("pages"), (200 + i % 5 * 100).alias("chunk_size"), (i % 3 * 40).alias("chunk_overlap"))
    return chunking.chunk_documents(docs).select("document_id", "idx", "page", "kind", "content")


@query(CHUNKS_SQL + " SELECT document_id, pos::INTEGER AS idx, substring(sha256(document_id || chr(31) || pos || chr(31) || content), 1, 32) AS id FROM pieces")
def chunk_ids(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")
    cut = chunking.chunk_pages(pages, keys=["document_id"], size=SIZE, overlap=OVERLAP).withColumnRenamed("pos", "idx")
    return chunking.assemble(cut).select("document_id", "idx", "id")


@query("""WITH RECURSIVE r AS (SELECT n_regionkey AS document_id, n_nationkey || ' | ' || n_name || ' | ' || n_regionkey AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey || ' | ' || n_name || ' | ' || n_regionkey) AS i FROM nation),
p AS (SELECT document_id, i, line, 20 + length(line) AS used, 0 AS g FROM r WHERE i = 1
  UNION ALL SELECT r.document_id, r.i, r.line, CASE WHEN used + length(r.line) + 1 > 60 THEN 20 + length(r.line) ELSE used + length(r.line) + 1 END, CASE WHEN used + length(r.line) + 1 > 60 THEN g + 1 ELSE g END FROM p JOIN r ON r.document_id = p.document_id AND r.i = p.i + 1)
SELECT document_id, g::INTEGER AS idx, 1 AS page, 'table' AS kind, 'key | name | region' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS content FROM p GROUP BY document_id, g""")
def table_pack(spark, sf):
    nations = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("key | name | region\n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" | ", "n_nationkey", "n_name", "n_regionkey"))), "\n")).alias("content"))
    block = F.struct(F.lit("table").alias("kind"), "content", *(F.lit(0.0).alias(c) for c in ("left", "right", "top", "bot")))
    docs = nations.select(F.col("n_regionkey").alias("document_id"), F.array(F.array(block)).alias("pages"))
    return chunking.chunk_documents(docs, size=60, overlap=0).select("document_id", "idx", "page", "kind", "content")


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(10)), lambda x: trim(x, ' ' || chr(9))) AS ls FROM documents)
SELECT doc_id, trim(regexp_replace(array_to_string(ls, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS text FROM l""")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


@query("SELECT doc_id, trim(replace(text, chr(10), ''), ' ' || chr(9)) AS text FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query("SELECT item_id, list_filter(regexp_split_to_array(text, '[ \\t\\n，。？！；、\"“”]+'), lambda t: length(t) >= 2) AS terms FROM benchmark")
def lex_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.lex_terms(F.col("text")).alias("terms"))


@query(f"SELECT doc_id, array_to_string({_TOKENS.replace('<t>', 'text')}, ' ') AS search FROM documents")
def search_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.search_string(F.col("text")).alias("search"))


@query("WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: strlen(x) > 5 AND strlen(x) <= 200) AS ls FROM documents) SELECT doc_id, coalesce(ls[1], '') AS title FROM l")
def infer_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.infer_title(F.col("text")).alias("title"))


@query("SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[ \\t\\n，。？！；、]+'), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: length(t) >= 2), '|') AS terms FROM conversations")
def plain_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(tx.plain_tokens(F.col("text")), "|").alias("terms"))


@query("SELECT doc_id, 'a.b-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.tar' ELSE '' END AS title FROM documents")
def title_from_filename(spark, sf):
    name = F.concat(F.lit("a.b-"), "doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(".tar")).otherwise(F.lit("")), F.lit(".pdf"))
    return table(spark, sf, "documents").select("doc_id", tx.title_from_filename(name).alias("title"))


@query("SELECT item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS latex FROM benchmark")
def clean_latex(spark, sf):
    """Formulas as a model replies: in a code fence, between delimiters, or with a dangling arrow."""
    t, i = F.col("text"), F.col("item_id") % 4
    fenced = F.concat(F.lit("```latex\n"), t, F.lit("\n```"))
    reply = F.when(i == 0, F.concat(F.lit("$$ "), t, F.lit(" $$"))).when(i == 1, fenced).when(i == 2, F.concat(F.lit("\\["), t, F.lit("\\]"))).otherwise(F.concat(t, F.lit(" \\rightarrow")))
    return table(spark, sf, "benchmark").select("item_id", tx.clean_latex(reply).alias("latex"))


@query("SELECT conv_id, turn, text LIKE '%not found%' AS refused, len(regexp_extract_all(replace(text, ',', ''), '-?[0-9]+(?:\\.[0-9]+)?')) AS numbers FROM conversations")
def reply_features(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.is_refusal(F.col("text")).alias("refused"), F.size(tx.numbers(F.col("text"))).cast("bigint").alias("numbers"))


# ---------------------------------------------------------------- pages


#: Lines of a page of glyphs, and words of a line.
PAGE_LINES, LINE_WORDS = 48, 5


def glyph_pages(spark: SparkSession, sf: str, *, placed: bool = True) -> DataFrame:
    """Each document's words as glyphs of two fonts, some of which can't be read, on as many pages as they fill."""
    return as_glyphs(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text"), placed=placed)


def as_glyphs(d: DataFrame, *, placed: bool = True) -> DataFrame:
    """The pages of ``glyph_pages`` of documents (document_id, text, and what else is to stay); without places, glyphs
    have what ``bad_fonts`` reads."""
    kept = [c for c in d.columns if c != "text"]
    d = d.select(*kept, F.split("text", " ").alias("ws"))
    each = PAGE_LINES * LINE_WORDS  # a multiple of 3, so fonts run on from page to page
    d = d.withColumn("page", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.size("ws") / each).cast("int")))))
    d = d.select(*kept, "page", F.slice("ws", (F.col("page") - 1) * each + 1, F.lit(each)).alias("ws"))

    def glyph(w, i):
        font, s = F.when(i % 3 == 0, F.lit("F0")).otherwise(F.lit("F1")).alias("font"), F.when((i % 3 == 0) & (F.col("document_id") % 4 == 0), F.lit("�")).otherwise(F.replace(w, F.lit("\n"), F.lit(" "))).alias("s")
        if not placed:
            return F.struct(font, s)
        return F.struct(font, F.lit(10.0).alias("font_size"), (F.lit(60.0) + (i % 5) * 80).alias("x"), (F.lit(700.0) - F.floor(i / 5) * 14).cast("double").alias("y"), (F.length(w) * 5.0).alias("w"), s)

    return d.select(*kept, "page", F.transform("ws", glyph).alias("glyphs"), F.array().cast("array<struct<x0: double, y0: double, x1: double, y1: double>>").alias("rects"))


@query("SELECT doc_id AS document_id, 'F0' AS font FROM documents WHERE doc_id % 4 = 0")
def bad_fonts(spark, sf):
    from ..operators.pages import bad_fonts as find

    return find(glyph_pages(spark, sf, placed=False))


@query()
def page_layout(spark, sf):
    from ..operators.pages import bad_fonts, extract_blocks, page_texts

    # documents meet their bad fonts as texts, before they are glyphs, which are many times as large
    bad = bad_fonts(glyph_pages(spark, sf, placed=False)).groupBy("document_id").agg(F.collect_set("font").alias("bad"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text").join(bad, "document_id", "left")
    return page_texts(extract_blocks(as_glyphs(d)))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w, unnest(range(len(string_split(coalesce(text, ''), ' ')))) AS i FROM documents)
SELECT doc_id AS document_id, (i // 240 + 1)::INTEGER AS page, regexp_replace(string_agg(w, '' ORDER BY i), '\\s+', '', 'g') AS letters FROM w GROUP BY ALL""")
def page_columns(spark, sf):
    """Each document's words set in two columns of up to 40 lines a page: read down the left one, then the right one."""
    from ..operators.pages import extract_blocks, page_texts

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.split(F.coalesce("text", F.lit("")), " ").alias("ws"))
    d = d.withColumn("page", F.explode(F.sequence(F.lit(1), F.ceil(F.size("ws") / 240).cast("int"))))
    d = d.select("document_id", "page", F.slice("ws", (F.col("page") - 1) * 240 + 1, F.lit(240)).alias("ws"))
    left = F.when(F.size("ws") < 120, F.lit(120)).otherwise(F.ceil(F.size("ws") / 6) * 3)  # a short page has one column

    def glyph(w, i):
        k = F.when(i < left, i).otherwise(i - left)
        x = F.when(i < left, F.lit(50.0)).otherwise(F.lit(350.0)) + k % 3 * 80
        return F.struct(F.lit("F1").alias("font"), F.lit(10.0).alias("font_size"), x.alias("x"), (700.0 - F.floor(k / 3) * 14).cast("double").alias("y"), F.lit(76.0).alias("w"), F.replace(w, F.lit("\n"), F.lit(" ")).alias("s"))

    pages = d.select("document_id", "page", F.transform("ws", glyph).alias("glyphs"), F.array().cast(_RECTS).alias("rects"))
    return page_texts(extract_blocks(pages, drop_bad_fonts=False)).select("document_id", "page", F.regexp_replace("text", r"\s+", "").alias("letters"))


_RECTS = "array<struct<x0: double, y0: double, x1: double, y1: double>>"


@query("SELECT n_regionkey AS document_id, 'table' AS kind, string_agg(n_nationkey || ' | ' || n_name || ' | ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY n_regionkey")
def drawn_tables(spark, sf):
    """Each region's nations in a grid of boxes on a page with a frame: ruled tables are read cell by cell."""
    from ..operators.pages import extract_blocks

    rows = table(spark, sf, "nation").withColumn("r", F.row_number().over(retrieval.Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    cells = rows.select("n_regionkey", "r", F.posexplode(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))).alias("c", "s"))
    x, y = F.lit(80.0) + F.col("c") * 150, F.lit(700.0) - F.col("r") * 20
    glyph = F.struct(F.lit("F1").alias("font"), F.lit(10.0).alias("font_size"), (x + 10).alias("x"), (y + 8).alias("y"), (F.length("s") * 5.0).alias("w"), "s")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 150).alias("x1"), (y + 20).alias("y1"))
    frame = F.array(F.struct(F.lit(20.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(580.0).alias("x1"), F.lit(780.0).alias("y1")))
    pages = cells.groupBy(F.col("n_regionkey").alias("document_id")).agg(F.lit(1).alias("page"), F.transform(F.array_sort(F.collect_list(F.struct("r", "c", glyph.alias("g")))), lambda z: z["g"]).alias("glyphs"), F.concat(frame, F.collect_list(box)).alias("rects"))
    return extract_blocks(pages).select("document_id", F.inline("blocks")).select("document_id", "kind", "content")


@query("""SELECT n_nationkey AS document_id, 0 AS pos, 'text' AS kind, n_name AS content, 0.0::DOUBLE AS top FROM nation UNION ALL SELECT n_nationkey, 1, 'formula', 'x=' || n_nationkey, 650.0 FROM nation
UNION ALL SELECT n_nationkey, 2, 'text', 'where x=1 is' || chr(10) || 'plain words', 0.0 FROM nation""")
def drawn_formulas(spark, sf):
    """A line of text, a display formula, and a formula within a line, which stays text; and a loose font without a sign."""
    from ..operators.pages import extract_blocks

    def glyph(font, x, y, s):
        return F.struct(F.lit(font).alias("font"), F.lit(10.0).alias("font_size"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), (F.length(s) * 5.0).alias("w"), s.alias("s"))

    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    glyphs = [glyph("F1", 60, 720, name), glyph("Cambria Math", 200, 650, F.lit("x")), glyph("Cambria Math", 206, 650, F.lit("=")), glyph("Cambria Math", 212, 650, key)]
    glyphs += [glyph("F1", 82, 560, F.lit("where ")), glyph("Cambria Math", 92, 560, F.lit("x=1")), glyph("F1", 108, 560, F.lit(" is")), glyph("TimesNewRomanPS-Bold", 60, 500, F.lit("plain words"))]
    pages = table(spark, sf, "nation").select(F.col("n_nationkey").alias("document_id"), F.lit(1).alias("page"), F.array(*glyphs).alias("glyphs"), F.array().cast(_RECTS).alias("rects"))
    found = extract_blocks(pages).select("document_id", F.posexplode("blocks").alias("pos", "b"))
    return found.select("document_id", "pos", "b.kind", "b.content", F.when(F.col("b.kind") == "formula", F.col("b.top")).otherwise(F.lit(0.0)).alias("top"))


# ---------------------------------------------------------------- evaluation


def evaluation_data(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, evidence, hits): every row whose id is divisible by 100 is a question, and the rows from it to the next
    one its evidence, of which some are found."""
    e, i = table(spark, sf, "embeddings").select("vec_id"), F.col("vec_id")
    queries = e.where("vec_id % 100 = 0").select(i.alias("qid"), F.concat(F.lit("R"), F.floor(i / 100) % 4 + 1).alias("retrieval_level"), F.when(F.floor(i / 100) % 7 == 0, F.lit("refuse")).otherwise(F.lit("answer")).alias("expected_behavior"))
    own = e.select((F.floor(i / 100) * 100).alias("qid"), i.alias("document_id"), F.lit(1).alias("page"))
    evidence = own.withColumns({"fact_id": F.concat(F.lit("f"), "document_id"), "quote": F.lit("no such quote"), "role": F.when(F.col("document_id") % 5 == 0, F.lit("supporting")).otherwise(F.lit("essential"))})
    hits = own.where((F.col("qid") / 100 + F.col("document_id")) % 3 == 0).withColumns({"content": F.lit("text"), "rank": (F.col("document_id") % 100 + 1).cast("int")})
    return queries, evidence, hits


EVALUATION_SQL = """queries AS (SELECT vec_id AS qid, 'R' || (vec_id // 100 % 4 + 1) AS retrieval_level, CASE WHEN vec_id // 100 % 7 = 0 THEN 'refuse' ELSE 'answer' END AS expected_behavior FROM embeddings WHERE vec_id % 100 = 0),
evidence AS (SELECT vec_id // 100 * 100 AS qid, vec_id AS document_id, vec_id % 5 <> 0 AS essential FROM embeddings),
ranked AS (SELECT e.*, CASE WHEN (qid // 100 + document_id) % 3 = 0 THEN document_id % 100 + 1 END AS page_rank FROM evidence e),
measured AS (SELECT qid, coalesce(avg(CASE WHEN essential THEN (page_rank IS NOT NULL)::INT::DOUBLE END), 0) AS page_recall, coalesce(1.0 / min(CASE WHEN essential THEN page_rank END), 0) AS page_mrr,
  avg(CASE WHEN NOT essential THEN (page_rank IS NOT NULL)::INT::DOUBLE END) AS supporting_page_recall FROM ranked GROUP BY qid),
metrics AS (SELECT q.qid, retrieval_level, expected_behavior, coalesce(page_recall, 0) AS page_recall, coalesce(page_mrr, 0) AS page_mrr, supporting_page_recall FROM queries q LEFT JOIN measured USING (qid))"""


@query(f"WITH {EVALUATION_SQL} SELECT qid, round(page_recall, 6) AS page_recall, round(page_mrr, 6) AS page_mrr, round(supporting_page_recall, 6) AS supporting_page_recall FROM metrics")
def page_recall_mrr(spark, sf):
    return evaluation.retrieval_metrics(*evaluation_data(spark, sf)).select("qid", *(F.round(c, 6).alias(c) for c in ("page_recall", "page_mrr", "supporting_page_recall")))


@query(f"""WITH {EVALUATION_SQL} SELECT retrieval_level, expected_behavior, count(*) AS queries, count(*) FILTER (expected_behavior <> 'refuse') AS graded_queries, count(*) FILTER (expected_behavior = 'refuse') AS refusal_queries,
round(avg(page_recall) FILTER (expected_behavior <> 'refuse'), 6) AS page_recall, round(avg(page_mrr) FILTER (expected_behavior <> 'refuse'), 6) AS page_mrr FROM metrics GROUP BY CUBE (retrieval_level, expected_behavior)""")
def metric_cube(spark, sf):
    m = evaluation.retrieval_metrics(*evaluation_data(spark, sf))
    return evaluation.summary(m, "retrieval_level", "expected_behavior", cube=True).drop("chunk_recall", "supporting_page_recall")


_FOLD = "regexp_replace(regexp_replace({t}, '\\s+', '', 'g'), '([A-Za-z])-([A-Za-z])', '\\1\\2', 'g')"


@query(f"""WITH h AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id)::INTEGER AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
folded AS (SELECT item_id, {_FOLD.format(t="text")} AS q FROM benchmark) SELECT item_id AS qid, 'f' || item_id AS fact_id, min(rank) AS chunk_rank FROM h JOIN folded USING (item_id) JOIN documents USING (doc_id) WHERE contains({_FOLD.format(t="text")}, q) GROUP BY item_id""")
def chunk_recall(spark, sf):
    b, d = table(spark, sf, "benchmark"), chunks(spark, sf)
    found = retrieval.passages_in(d, b.select(F.col("item_id").alias("qid"), "text")).join(d.select(*retrieval.KEY, "content"), retrieval.KEY)
    hits = found.withColumn("rank", F.row_number().over(retrieval.Window.partitionBy("qid").orderBy("document_id")))
    evidence = b.select(F.col("item_id").alias("qid"), F.concat(F.lit("f"), "item_id").alias("fact_id"), F.col("text").alias("quote"))
    return evaluation.chunk_ranks(evidence, hits)


@query("SELECT event_type AS name, count(*) AS spans, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def span_p95(spark, sf):
    return evaluation.span_p95(table(spark, sf, "events"), name="event_type", dur="value").withColumnRenamed("event_type", "name")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS name, count(*) AS spans, round(avg(value), 6) AS mean_dur FROM events GROUP BY ALL")
def span_window_counts(spark, sf):
    return span_windows(table(spark, sf, "events")).withColumn("mean_dur", F.round("mean_dur", 6))


_BEHAVIOR_SQL = "CASE WHEN vec_id % 7 = 0 THEN 'refuse' ELSE 'answer' END"


@query("""WITH evidence AS (SELECT vec_id // 100 * 100 AS qid, vec_id AS document_id FROM embeddings WHERE vec_id % 5 <> 0)
SELECT qid, round(avg((document_id % 4 = 0)::INT::DOUBLE), 6) AS citation_page_recall FROM evidence GROUP BY qid""")
def citation_recall(spark, sf):
    """Answers that cite a fourth of their evidence, twice, and a page that is none."""
    _, evidence, _ = evaluation_data(spark, sf)
    cited = evidence.where("document_id % 4 = 0").groupBy("qid").agg(F.collect_list(F.struct("document_id", "page")).alias("c"))
    answers = cited.select("qid", F.concat("c", "c", F.transform("c", lambda x: F.struct(x["document_id"], F.lit(9).alias("page")))).alias("citations"))
    return evaluation.citation_recall(evidence, answers).withColumn("citation_page_recall", F.round("citation_page_recall", 6))


@query(f"""WITH j AS (SELECT label, vec_id, {_BEHAVIOR_SQL} = 'refuse' AS refuse, CASE WHEN vec_id % 9 = 0 THEN 'judge_error' WHEN vec_id % 7 = 0 THEN CASE WHEN vec_id % 2 = 0 THEN 'refused' ELSE 'hallucinated' END WHEN vec_id % 3 = 0 THEN 'correct' WHEN vec_id % 3 = 1 THEN 'partial' ELSE 'wrong' END AS v FROM embeddings),
g AS (SELECT *, NOT refuse AND v <> 'judge_error' AS ok FROM j)
SELECT label, round(count(*) FILTER (ok AND v = 'correct') / nullif(count(*) FILTER (ok), 0), 6) AS answer_accuracy, round(count(*) FILTER (ok AND v = 'partial') / nullif(count(*) FILTER (ok), 0), 6) AS answer_partial_rate,
round(count(*) FILTER (ok AND v = 'wrong') / nullif(count(*) FILTER (ok), 0), 6) AS answer_wrong_rate, round(sum(CASE WHEN ok THEN (vec_id % 2 = 0)::INT + (vec_id % 5 = 0)::INT END) / nullif(2 * count(*) FILTER (ok), 0), 6) AS keypoint_coverage,
round(count(*) FILTER (refuse AND v = 'refused') / nullif(count(*) FILTER (refuse AND v <> 'judge_error'), 0), 6) AS refusal_accuracy,
(count(*) FILTER (refuse AND v = 'hallucinated') + count(*) FILTER (ok AND vec_id % 11 = 0))::BIGINT AS hallucination_count, count(*) FILTER (v = 'judge_error') AS judge_error_count FROM g GROUP BY label""")
def answer_correctness(spark, sf):
    i = F.col("vec_id")
    verdict = F.when(i % 9 == 0, "judge_error").when(i % 7 == 0, F.when(i % 2 == 0, "refused").otherwise("hallucinated")).when(i % 3 == 0, "correct").when(i % 3 == 1, "partial").otherwise("wrong")
    judged = table(spark, sf, "embeddings").select(
        "label", F.when(i % 7 == 0, F.lit("refuse")).otherwise(F.lit("answer")).alias("expected_behavior"), verdict.alias("verdict"), F.array(i % 2 == 0, i % 5 == 0).alias("keypoint_hits"),
        F.when(i % 11 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("forbidden_violations"),
    )
    out = evaluation.correctness_summary(judged, "label")
    return out.select("label", *(F.round(c, 6).alias(c) for c in out.columns[1:6]), "hallucination_count", "judge_error_count")


@query("""SELECT vec_id AS qid, 'numeric' AS lane, CASE WHEN vec_id % 5 = 4 THEN 'judge_error' WHEN vec_id % 5 = 0 THEN 'correct' WHEN vec_id % 5 = 1 THEN 'wrong' WHEN vec_id % 5 = 2 THEN 'partial' ELSE CASE WHEN vec_id % 2 = 0 THEN 'correct' ELSE 'partial' END END AS verdict,
CASE vec_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS hits FROM embeddings""")
def numeric_verdicts(spark, sf):
    """Replies of five kinds: within tolerance, beyond it, without the unit asked for, two labelled values of which one may
    stand at the other's label, and questions without a number."""
    i = F.col("vec_id")
    n = (i + 1000).cast("string")
    one = '{"expected_behavior": "answer", "answer": {"type": "numeric", "value": %s, "unit": "kN", "tolerance": {"mode": "relative", "value": 0.01}}, "output_format": {"unit_required": true}}'
    question = F.when(i % 5 == 4, F.lit(one % "null")).when(i % 5 == 3, F.concat(F.lit('{"answer": {"type": "composite", "value": {"左_kN": 11, "右": {"力_kN": '), n, F.lit("}}}}"))).otherwise(F.concat(F.lit(one.split("%s")[0]), n, F.lit(one.split("%s")[1])))
    far = "，其余的文字在这里占据足够长的位置，"
    reply = (
        F.when(i % 5 == 0, F.concat(F.lit("about "), F.format_number((i + 1000) * 1.005, 2), F.lit(" kN"))).when(i % 5 == 1, F.concat(((i + 1000) * 2).cast("string"), F.lit(" kN"))).when(i % 5 == 2, n)
        .when(i % 2 == 0, F.concat(F.lit(f"左侧为11{far}力为"), n)).otherwise(F.concat(F.lit(f"左侧为11{far}再加上另外一段文字{far}"), n, F.lit(far + far), F.lit("力")))
    )
    judged = evaluation.judge_answers(table(spark, sf, "embeddings").select(i.alias("qid"), question.alias("question"), reply.alias("answer")))
    return judged.select("qid", "lane", "verdict", F.size(F.filter("keypoint_hits", lambda h: h)).alias("hits"))


def fact_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of two pages: the first thousand characters, and the rest."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.struct(F.lit(1).alias("page"), F.substring("text", 1, 1000).alias("text")), F.struct(F.lit(2).alias("page"), F.expr("substring(text, 1001)").alias("text")))).alias("p")).select("document_id", "p.*")


_FOLDED = "regexp_replace(regexp_replace(nfc_normalize({t}), '\\s+', '', 'g'), '([A-Za-z])-([A-Za-z])', '\\1\\2', 'g')"


@query(f"""WITH p AS (SELECT doc_id, {_FOLDED.format(t="substring(text, 1, 1000)")} AS a, {_FOLDED.format(t="substring(text, 1001)")} AS b,
  {_FOLDED.format(t="CASE doc_id % 3 WHEN 0 THEN substring(text, 301, 200) WHEN 1 THEN 'no such passage ' || doc_id ELSE substring(text, 901, 200) END")} AS q FROM documents WHERE text IS NOT NULL),
j AS (SELECT *, coalesce(list_max(list_filter(range(0, least(length(a), length(b), 200)::BIGINT + 1), lambda n: right(a, n::INTEGER) = left(b, n::INTEGER))), 0) AS n FROM p)
SELECT CASE WHEN contains(a, q) THEN 'OK' WHEN contains(a || substring(b, n::INTEGER + 1), q) THEN 'SPLIT' ELSE 'MISSING' END AS state, count(*) AS facts FROM j GROUP BY 1""")
def gate_states(spark, sf):
    """Facts from within a page, from none, and from where a page ends, against chunks that overlap."""
    pages = fact_pages(spark, sf)
    cut = chunking.chunk_pages(pages, keys=["document_id"], size=SIZE, overlap=OVERLAP).withColumnRenamed("pos", "idx")
    i = F.col("doc_id")
    quote = F.when(i % 3 == 0, F.substring("text", 301, 200)).when(i % 3 == 1, F.concat(F.lit("no such passage "), i)).otherwise(F.substring("text", 901, 200))
    facts = table(spark, sf, "documents").where("text IS NOT NULL").select(F.concat(F.lit("f"), i).alias("fact_id"), i.alias("document_id"), F.lit(1).alias("page"), quote.alias("quote"))
    return evaluation.gate_counts(evaluation.chunk_gate(facts, cut))


@query(f"""SELECT 'f' || doc_id AS fact_id, ((length(f) - length(replace(f, 'the', ''))) // 3)::INTEGER AS hits FROM (SELECT doc_id, {_FOLDED.format(t="text")} AS f FROM documents WHERE text IS NOT NULL)""")
def quote_hits(spark, sf):
    pages = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")
    facts = pages.select(F.concat(F.lit("f"), "document_id").alias("fact_id"), "document_id", "page", F.lit("t h e").alias("quote"))
    return evaluation.quote_hits(facts, pages)


@query(f"""WITH {STORED_SQL}, n AS (SELECT 'same-' || doc_id // 3 || '.pdf' AS filename, max(id::BIGINT)::VARCHAR AS document_id, count(*) AS matches FROM stored GROUP BY 1)
SELECT 'L' || doc_id AS doc_id, document_id, coalesce(matches, 0) AS matches FROM stored LEFT JOIN n ON n.filename = 'same-' || doc_id || '.pdf'""")
def ledger_documents(spark, sf):
    """The stored document of each ledger row, by file name, the newest of several."""
    held = stored(spark, sf).withColumn("filename", F.concat(F.lit("same-"), F.floor(F.col("id").cast("bigint") / 3), F.lit(".pdf")))
    ledger = table(spark, sf, "documents").select(F.concat(F.lit("L"), "doc_id").alias("doc_id"), F.concat(F.lit("same-"), "doc_id", F.lit(".pdf")).alias("filename"))
    return first_by_filename(ledger, held)


def ledger(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.when(i % 4 < 2, F.concat(F.lit("D"), F.floor(i / 2) * 2)).otherwise(F.concat(F.lit("D"), i)).alias("doc_id"), F.concat(F.lit("doc-"), i, F.lit(".pdf")).alias("filename"), F.when(i % 10 != 0, F.lit("title")).otherwise(F.lit("")).alias("title"),
        F.lit("paper").alias("genre"), F.lit("en").alias("language"), F.lit(5).alias("pages"), F.when(i % 9 == 0, F.lit("needs_ocr")).otherwise(F.lit("ok")).alias("status"), F.sha2("text", 256).alias("sha256"), F.array(F.lit(1), F.lit(4)).alias("page_range"), i.alias("i"),
    )


@query("""WITH l AS (SELECT doc_id AS i, CASE WHEN doc_id % 4 < 2 THEN 'D' || doc_id // 2 * 2 ELSE 'D' || doc_id END AS d, text FROM documents)
SELECT 'docs/' || d AS place, 'missing title' AS message FROM l WHERE i % 10 = 0
UNION ALL SELECT 'docs/' || d, 'doc_id is not unique' FROM (SELECT *, count(*) OVER (PARTITION BY d) AS n FROM l) WHERE n > 1
UNION ALL SELECT 'docs/' || d, 'file is missing' FROM l WHERE i % 6 = 0
UNION ALL SELECT 'docs/' || d, 'sha256 differs' FROM l WHERE i % 6 <> 0 AND i % 8 = 1 AND text IS NOT NULL
UNION ALL SELECT 'docs/' || d, 'warning: page count differs' FROM l WHERE i % 6 <> 0 AND i % 5 = 1""")
def ledger_errors(spark, sf):
    rows = ledger(spark, sf)
    i = F.col("i")
    files = rows.where(i % 6 != 0).select("filename", F.when(i % 8 == 1, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"), F.when(i % 5 == 1, F.lit(6)).otherwise(F.col("pages")).alias("pages"))
    return evaluation.check_documents(rows, files)


@query("""WITH f AS (SELECT doc_id AS i, 'facts/F' || doc_id AS place FROM documents)
SELECT place, 'type is unknown' AS message FROM f WHERE i % 8 = 0 UNION ALL SELECT place, 'document is unknown' FROM f WHERE i % 7 = 0 UNION ALL SELECT place, 'document needs OCR' FROM f WHERE i % 7 <> 0 AND i % 9 = 0
UNION ALL SELECT place, 'page is out of range' FROM f WHERE i % 7 <> 0 AND i % 6 IN (0) UNION ALL SELECT place, 'page is outside page_range' FROM f WHERE i % 7 <> 0 AND i % 6 IN (0, 5)
UNION ALL SELECT place, 'quote is too short' FROM f WHERE i % 3 = 2 UNION ALL SELECT place, 'missing section' FROM f WHERE i % 10 = 3""")
def fact_errors(spark, sf):
    i = F.col("doc_id")
    facts = table(spark, sf, "documents").select(
        F.concat(F.lit("F"), i).alias("fact_id"), F.when(i % 8 == 0, F.lit("odd")).otherwise(F.lit("verbatim")).alias("type"), F.lit("claim").alias("claim"), F.when(i % 7 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("E"), i)).alias("doc"),
        (i % 6).cast("int").alias("page"), F.when(i % 10 != 3, F.lit("1.2")).alias("section"), F.when(i % 3 == 2, F.lit("too - short")).otherwise(F.lit("a quote that is long enough")).alias("quote"),
    )
    return evaluation.check_facts(facts, ledger(spark, sf).withColumn("doc_id", F.concat(F.lit("E"), "i")))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["hybrid_search"](spark, sf)


