"""Tables that change, on Parquet: rows lie in buckets by id, and a numbered pointer says which folders hold.

A change rewrites the buckets that its ids fall into, beside the old ones, and an append adds folders; both become true
when the next pointer is renamed into place, for all their tables at once. Readers take the newest pointer that can be
read, so they see one state or another and a write that fails, wherever it stops, changes nothing. One writer at a time;
old folders stay until ``vacuum``. Files are reached through Spark's own file systems, so a store can stand wherever Spark
reads and writes.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.documents import CHUNKS, DOCUMENTS

POINTER = re.compile(r"^pointer-(\d{20})\.json$")
#: Buckets of a new table, and the column by which rows of each table are dealt: a document and its chunks lie together.
BUCKETS = 32
KEYS = {"chunks": "document_id", "verdicts": "arrival"}


class Store:
    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType] | None = None, *, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schemas = {"documents": DOCUMENTS, "chunks": CHUNKS} if schemas is None else schemas

    # ------------------------------------------------------------ pointers

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _listed(self, name: str) -> list[str]:
        folder, fs = self._file(name)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def _pointers(self) -> list[str]:
        return sorted((n for n in self._listed("") if POINTER.match(n)), reverse=True)

    def _state(self) -> dict:
        """{"buckets": how many, "tables": {table: {bucket: [folders]}}} of the newest pointer that can be read."""
        for name in self._pointers():
            path, fs = self._file(name)
            stream = fs.open(path)
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:
                continue
            finally:
                stream.close()
        return {"buckets": self.buckets, "tables": {}}

    def _point(self, state: dict) -> None:
        path, fs = self._file(f"new-{uuid.uuid4().hex}.json")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        last = next(iter(self._pointers()), None)
        final, _ = self._file(f"pointer-{int(POINTER.match(last)[1]) + 1 if last else 1:020d}.json")
        if fs.exists(final) or not fs.rename(path, final):
            raise OSError(f"{final} is another writer's")

    # ------------------------------------------------------------ rows

    def _bucket(self, table: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(KEYS.get(table, "id")).cast("string")), F.lit(buckets)).cast("int")

    def _put(self, table: str, df: DataFrame, buckets: int) -> dict[str, str]:
        """Write rows by bucket; the folder of each bucket that has any."""
        folder, schema = f"{table}/{uuid.uuid4().hex}", self.schemas[table]
        rows = df.select(*(df[f.name].cast(f.dataType) for f in schema)).toDF(*schema.names)
        rows.withColumn("_bucket", self._bucket(table, buckets)).repartition("_bucket", F.pmod(F.hash(*schema.names[:2]), F.lit(8))).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {n.removeprefix("_bucket="): f"{folder}/{n}" for n in self._listed(folder) if n.startswith("_bucket=")}

    def _rows(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, table: str) -> DataFrame:
        held = self._state()["tables"].get(table, {})
        return self._rows(table, [f for folders in held.values() for f in folders])

    def write(self, **tables: DataFrame) -> None:
        """Replace these tables, all at once."""
        state = self._state()
        put = {table: {k: [f] for k, f in self._put(table, df, state["buckets"]).items()} for table, df in tables.items()}
        self._point(state | {"tables": state["tables"] | put})

    def append(self, replaced: dict[str, DataFrame] | None = None, /, **tables: DataFrame) -> None:
        """Add rows to these tables, all at once; what is there isn't read. ``replaced``: tables that change as a whole."""
        state = self._state()
        for table, df in (replaced or {}).items():
            state["tables"][table] = {k: [f] for k, f in self._put(table, df, state["buckets"]).items()}
        for table, df in tables.items():
            held = state["tables"].setdefault(table, {})
            for k, folder in self._put(table, df, state["buckets"]).items():
                held[k] = [*held.get(k, []), folder]
        self._point(state)

    def change(self, ids: DataFrame, **tables: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrite the buckets in which ``ids`` (id) lie, all at once: each table's function makes of their rows what they
        hold afterwards, rows of ``ids`` among them. Other buckets aren't touched. How many buckets were."""
        state = self._state()
        touched = sorted(str(r[0]) for r in ids.select(self._bucket("documents", state["buckets"])).distinct().collect())
        if not touched:
            return 0
        for table, make in tables.items():
            held = state["tables"].setdefault(table, {})
            put = self._put(table, make(self._rows(table, [f for k in touched for f in held.get(k, [])])), state["buckets"])
            if stray := set(put) - set(touched):
                raise ValueError(f"{table}: rows of other buckets than those of the ids: {sorted(stray)}")
            for k in touched:
                held.pop(k, None)
            held |= {k: [f] for k, f in put.items()}
        self._point(state)
        return len(touched)

    def vacuum(self) -> int:
        """Delete what the newest pointer doesn't name, older pointers too; how many folders of buckets went."""
        state, gone = self._state(), 0
        named = {f for held in state["tables"].values() for folders in held.values() for f in folders}
        for table in self.schemas:
            for version in self._listed(table):
                parts = [f"{table}/{version}/{n}" for n in self._listed(f"{table}/{version}") if n.startswith("_bucket=")]
                for part in parts:
                    if part not in named:
                        path, fs = self._file(part)
                        fs.delete(path, True)
                        gone += 1
                if not named.intersection(parts):
                    path, fs = self._file(f"{table}/{version}")
                    fs.delete(path, True)
        for name in self._pointers()[1:] + [n for n in self._listed("") if n.startswith("new-")]:
            path, fs = self._file(name)
            fs.delete(path, False)
        return gone
