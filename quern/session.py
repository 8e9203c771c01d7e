"""What a session needs before its executors can run this package's functions."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Rows and bytes of an Arrow batch that goes to Python: bounds a worker's memory whatever the length of rows.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; without it 10,000 rows go to Python at once, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _archive() -> bytes:
    top = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    return held.getvalue()


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once for each context: through the folder in spark.checkpoint.dir, which
    all machines share; where that is unset, as in tests, from a temporary file. Batches are bounded each time."""
    bound_batches(spark)
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    data = _archive()
    name = f"quern-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        path = os.path.join(tempfile.mkdtemp(), name)
        with open(path, "wb") as f:
            f.write(data)
    else:
        path = f"{folder.rstrip('/')}/{sc.applicationId}-{name}"
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(path)
    sc._quern_shipped = True
