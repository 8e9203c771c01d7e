"""What the operators share: shipping the package, tables in the shared folder, and the word kernel.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as
``[^\\x20\\x09-\\x0D]+`` over characters. The kernel works on Arrow's own buffers with numpy, so no
Python object is made per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text that the kernels take at a time, unless one document is longer.
CHUNK = 1 << 19


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and make this package importable on executors, once for each context."""
    ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset one is made in local mode, as in
    tests; on a cluster a folder of this machine would be of no use, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    return folder


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: ends its lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quern_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later result reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._quern_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def numbered(docs: DataFrame, kept: list[str], text_col: str) -> tuple[DataFrame, str]:
    """(the ``kept`` columns under numbers and then the text, the start of their schema): names can't clash with any."""
    rows = docs.select(*(docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(kept)), docs[text_col].alias("text"))
    return rows, "".join(f"c{k} {docs.schema[c].dataType.simpleString()}, " for k, c in enumerate(kept))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or the like, that no column of ``docs`` has."""
    while name in docs.columns:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """The 128-bit digest by which a text is known whatever its ids, as a native expression; empty for null."""
    return F.coalesce(F.substring(F.unhex(F.sha2(text, 256)), 1, 16), F.unhex(F.lit("")))


# ---------------------------------------------------------------- texts in Arrow batches

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240611)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    key = f"{base}"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            more = min(done, size - done)
            np.multiply(have[:more], np.uint64(pow(base, done, 1 << 64)), out=have[done : done + more])
            done += more
        _powers[key] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit over all (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings, and where each text begins (with the end after the last). Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` bytes together; a longer text comes alone and whole."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and byte after the last, of every word; none crosses from one text into the next."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | edge[1:n]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | edge[1:n]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * _power_table(BASE, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power_table(UNBASE, n)[starts] + (ends - starts).astype(np.uint64))


def scan_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, first byte, byte after the last) of every word, and the first word of each text."""
    starts, ends = word_spans(data, offsets)
    return span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; grams that cross texts are for the caller to leave out."""
    m = max(0, len(words) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + m]
    return mix(h + np.uint64(n))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
