"""Ingest as a stream: files that arrive in a folder become documents and chunks, batch by batch.

The stream's checkpoint takes the place of a queue: it knows which files were taken, and a batch that failed is run
again. Running one twice changes nothing, since content that a user has is a duplicate and a document's chunks are
replaced, not added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..plans.engine import Engine

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def owner_from_folder(path: Column) -> Column:
    """Files lie in a folder that is named after their owner."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def file_stream(spark: SparkSession, path: str, *, per_batch: int = 100) -> DataFrame:
    """The .pdf files below ``path``, one row each, as they arrive."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(
        owner_from_folder(F.col("path")).alias("user_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "content", content_hash(F.col("content")).alias("content_hash"),
        F.col("length").alias("size_bytes"), F.concat_ws("|", F.col("modificationTime").cast("string"), "path").alias("arrival"),
    )


def ingest_stream(engine: Engine, files: DataFrame, checkpoint: str, *, once: bool = True, seconds: int = 5) -> StreamingQuery:
    """Start ingesting. ``once``: all there is, then stop; else look every ``seconds``."""

    def take(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.accept(batch.drop("content"))
            engine.run(batch)

    engine.recover()
    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def span_windows(spans: DataFrame, *, window: str = "1 hour", late: str = "1 hour", name: str = "event_type", at: str = "ts", dur: str = "value") -> DataFrame:
    """Counts and mean durations of spans by name and tumbling window, for batches and for streams with late rows."""
    timed = spans.withWatermark(at, late) if spans.isStreaming else spans
    return timed.groupBy(F.window(at, window).alias("w"), F.col(name).alias("name")).agg(F.count("*").alias("spans"), F.avg(dur).alias("mean_dur")).select(F.col("w.start").alias("start"), "name", "spans", "mean_dur")
