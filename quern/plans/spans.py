"""Spans: how long each stage took, for which request and run, as rows for ``operators.evaluation.span_p95``."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SPANS = "name string, dur double, ok boolean, error string, rid string, run_id string, tags map<string, string>, ts timestamp"


@dataclass
class SpanLog:
    """Rows are kept until ``flush`` appends them to a table; ``request`` sets what the spans inside it belong to."""

    run_id: str = ""
    rows: list[tuple] = field(default_factory=list)
    rid: str = ""

    @contextmanager
    def request(self, rid: str | None = None) -> Iterator[str]:
        before, self.rid = self.rid, rid or uuid.uuid4().hex[:12]
        try:
            yield self.rid
        finally:
            self.rid = before

    @contextmanager
    def span(self, name: str, **tags: object) -> Iterator[dict[str, object]]:
        """Times its block; what the block adds to the tags is logged with it. An error is logged and goes on."""
        at, began, error = time.time(), time.perf_counter(), None
        try:
            yield tags
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            raise
        finally:
            own = {k: str(v) for k, v in tags.items()}
            self.rows.append((name, 1000 * (time.perf_counter() - began), error is None, error, self.rid, self.run_id, own, at))

    def frame(self, spark: SparkSession) -> DataFrame:
        from datetime import UTC, datetime

        rows = [(*r[:-1], datetime.fromtimestamp(r[-1], UTC)) for r in self.rows]
        return spark.createDataFrame(rows, SPANS)

    def flush(self, spark: SparkSession, path: str) -> None:
        if self.rows:
            self.frame(spark).coalesce(1).write.mode("append").parquet(path)
            self.rows.clear()
