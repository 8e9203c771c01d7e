"""The documents table as DataFrame operations: each write is a new state of the table, derived from the old one.

States: pending, processing, ready, failed. A failed document never stands in the way of its content's return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_pdf, stable_id
from .retrieval import owned

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("page_count", T.IntegerType()), T.StructField("size_bytes", T.LongType()), T.StructField("chunk_count", T.IntegerType()), T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("chunk_size", T.IntegerType()), T.StructField("chunk_overlap", T.IntegerType()),
        T.StructField("updated_at", T.TimestampType()), T.StructField("created_at", T.TimestampType()),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("document_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("idx", T.IntegerType()),
        T.StructField("content", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("created_at", T.TimestampType()),
    ]
)
VERDICTS = T.StructType([T.StructField(c, T.StringType()) for c in ("arrival", "user_id", "filename", "id", "status", "message")])
#: What saving a document again may change.
UPDATABLE = ["filename", "title", "page_count", "size_bytes", "chunk_count", "status", "error", "chunk_size", "chunk_overlap"]
MAX_UPLOAD_MB = 20


class InvalidChunking(ValueError):
    pass


def scope(user: str | None, owner: str = "user_id") -> Column:
    """Rows that ``user`` may see; none or empty: all."""
    return owned(F.lit(user), F.col(owner))


def get(documents: DataFrame, document_id: str, user: str | None = None) -> DataFrame:
    return documents.where((F.col("id") == document_id) & scope(user))


def listing(documents: DataFrame, user: str | None = None) -> DataFrame:
    """Newest first; null titles and errors read as empty."""
    return documents.where(scope(user)).withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "error", "content_hash") if c in documents.columns}).orderBy(F.desc("created_at"), "id")


def by_hash(documents: DataFrame, content_hash: str, user: str) -> DataFrame:
    """The document of one owner with this content; one that has not failed before one that has, then the oldest."""
    same = documents.where((F.col("content_hash") == content_hash) & (F.col("user_id") == user))
    return same.orderBy(F.col("status") == "failed", "created_at", "id").limit(1)


def upsert(documents: DataFrame, saved: DataFrame, *, now: Column | None = None) -> DataFrame:
    """``documents`` with ``saved`` inserted by id, or its UPDATABLE columns put over the row that stands there.

    Owner, hash and creation stay; updated_at is set by an update only. Of several saved rows of an id one counts.
    """
    now = F.current_timestamp() if now is None else now
    new = saved.dropDuplicates(["id"]).select(*documents.columns).alias("n")
    joined = documents.alias("o").join(new, F.col("o.id") == F.col("n.id"), "full_outer")
    was, comes = F.col("o.id").isNotNull(), F.col("n.id").isNotNull()

    def column(c: str) -> Column:
        if c == "updated_at":
            return F.when(was & comes, now).otherwise(F.col(f"o.{c}"))
        if c in UPDATABLE:
            return F.when(comes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    return joined.select(*(column(c).alias(c) for c in documents.columns))


def delete(documents: DataFrame, chunks: DataFrame, ids: DataFrame, user: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents left, chunks left, ids that were deleted): ``ids`` (id) of rows that ``user`` may see, and all
    their chunks."""
    gone = documents.where(scope(user)).join(ids, "id", "left_semi").select("id")
    return documents.join(gone, "id", "left_anti"), chunks.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti"), gone


def delete_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def claim(documents: DataFrame, n: int | None = 1, *, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents after, claimed): the ``n`` oldest pending documents go to processing; None: all, without a sort."""
    now = F.current_timestamp() if now is None else now
    if n is None:
        mine = F.col("status") == "pending"
        after = documents.withColumn("updated_at", F.when(mine, now).otherwise(F.col("updated_at"))).withColumn("status", F.when(mine, F.lit("processing")).otherwise(F.col("status")))
        return after, documents.where(mine).withColumns({"status": F.lit("processing"), "updated_at": now})
    taken = documents.where("status = 'pending'").orderBy("created_at", "id").limit(n).select("id").withColumn("_taken", F.lit(True))
    marked = documents.join(taken, "id", "left")
    after = marked.withColumn("status", F.when(F.col("_taken"), F.lit("processing")).otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_taken"), now).otherwise(F.col("updated_at")))
    return after.select(*documents.columns), after.where("_taken").select(*documents.columns)


def reset_processing(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents after, one row with n): what was being processed is pending again."""
    count = documents.agg(F.count_if(F.col("status") == "processing").alias("n"))
    return documents.withColumn("status", F.when(F.col("status") == "processing", F.lit("pending")).otherwise(F.col("status"))), count


def fail(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """Documents of ``errors`` (id, message) are failed with that message."""
    joined = documents.join(errors.select("id", F.col("message").alias("_m")).dropDuplicates(["id"]), "id", "left")
    hit = F.col("_m").isNotNull()
    return joined.withColumn("status", F.when(hit, F.lit("failed")).otherwise(F.col("status"))).withColumn("error", F.when(hit, F.col("_m")).otherwise(F.col("error"))).select(*documents.columns)


def migrate_owner(documents: DataFrame, old: str = "local", new: str = "admin") -> DataFrame:
    return documents.withColumn("user_id", F.when(F.col("user_id") == old, F.lit(new)).otherwise(F.col("user_id")))


def resolve_chunking(base: tuple[int, int], *wishes: tuple[int | None, int | None] | None) -> tuple[int, int]:
    """(size, overlap): the first wish that names each, else the base. Overlap must be below size where a wish named
    it; a size alone may fall to the base's overlap or below, which chunking then takes as a quarter of the size."""
    size, overlap, named = base[0], base[1], False
    for wish in reversed([w for w in wishes if w is not None]):
        if wish[0] is not None:
            if wish[0] < 1:
                raise InvalidChunking(f"chunk_size {wish[0]} is below 1")
            size = wish[0]
        if wish[1] is not None:
            if wish[1] < 0:
                raise InvalidChunking(f"chunk_overlap {wish[1]} is negative")
            overlap, named = wish[1], True
    if named and overlap >= size:
        raise InvalidChunking(f"chunk_overlap {overlap} isn't below chunk_size {size}")
    return size, overlap if overlap < size else size // 4


def accept(documents: DataFrame, uploads: DataFrame, *, max_mb: int = MAX_UPLOAD_MB, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new pending documents, one verdict for each upload).

    ``uploads``: user_id, filename, content_hash, size_bytes, arrival (orders them), and chunk_size, chunk_overlap.
    Files of another type or too large are refused; content that its owner already has, failed documents aside, or
    that came earlier in the same batch is a duplicate of that document. Ids follow from owner, content and arrival.
    """
    now = F.current_timestamp() if now is None else now
    error = F.when(~is_pdf(F.col("filename")), F.lit("only .pdf files are taken")).when(F.col("size_bytes") > max_mb * 1024 * 1024, F.lit(f"the file is larger than {max_mb} MB"))
    judged = uploads.withColumn("message", error)
    first = Window.partitionBy("user_id", "content_hash", F.col("message").isNull()).orderBy("arrival", "filename")
    new_id = stable_id(F.col("user_id"), F.col("content_hash"), F.col("arrival"))
    judged = judged.withColumn("_n", F.row_number().over(first)).withColumn("_own", F.first(new_id).over(first))
    live = documents.where("status <> 'failed'").groupBy("user_id", "content_hash").agg(F.min_by("id", "created_at").alias("_live"))
    met = judged.join(live, ["user_id", "content_hash"], "left")
    verdict = F.when(F.col("message").isNotNull(), F.lit("failed")).when(F.col("_live").isNotNull() | (F.col("_n") > 1), F.lit("duplicate")).otherwise(F.lit("pending"))
    verdicts = met.withColumn("status", verdict).withColumn("id", F.when(F.col("message").isNull(), F.coalesce("_live", "_own")))
    fresh = verdicts.where("status = 'pending'").select(
        "id", "user_id", "filename", F.lit(None).cast("string").alias("title"), F.lit(0).alias("page_count"), F.col("size_bytes").cast("bigint").alias("size_bytes"), F.lit(0).alias("chunk_count"),
        "status", F.lit(None).cast("string").alias("error"), "content_hash", F.col("chunk_size").cast("int").alias("chunk_size"), F.col("chunk_overlap").cast("int").alias("chunk_overlap"),
        F.lit(None).cast("timestamp").alias("updated_at"), now.alias("created_at"),
    )
    return fresh, verdicts.select("arrival", "user_id", "filename", "id", "status", "message")


def upload_summary(verdicts: DataFrame, *keys: str) -> DataFrame:
    many = lambda s: F.count_if(F.col("status") == s)
    return verdicts.groupBy(*keys).agg(F.count("*").alias("total"), (F.count("*") - many("failed")).alias("success"), many("failed").alias("failed"), many("duplicate").alias("duplicate"))
