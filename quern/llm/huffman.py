"""Token ids in files: canonical, length-limited Huffman codes from global counts, in blocks that decode alone.

A store is a folder with two tables. ``codes`` holds the length in bits of each id's code; canonical codes follow
from lengths alone. ``blocks`` holds, in the order of documents, the ids of whole documents as one string of bits:
shard and block number, the documents' ids and sizes, the ids before the block in its shard, and the bit at which
every CHECK-th id begins. A reader decodes all these stretches of a block side by side with one table that maps the
next LIMIT bits to an id and a length. Tables are Parquet, written and committed by Spark, so a store can stand in
any file system that Spark writes and a lost executor's blocks are made again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, forget, prepare
from .tokens import opened, text_chunks

#: Most bits of a code; ids between checkpoints; ids of a block, unless one document has more.
LIMIT, CHECK, BLOCK = 20, 256, 1 << 17


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, 0 where the count is 0, by package-merge: least total within ``limit``."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols have no codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    leaf_first: list[np.ndarray] = []
    row = leaves
    kinds = np.ones(len(leaves), bool)
    leaf_first.append(kinds)
    for _ in range(limit - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        sorted_ = np.argsort(both, kind="stable")
        row = both[sorted_]
        leaf_first.append(sorted_ < len(leaves))
    take, bits = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for kinds in reversed(leaf_first):
        own = int(kinds[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    out[order] = bits
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        code <<= bits - last
        last = bits
        own = order[np.searchsorted(lengths[order], bits) : np.searchsorted(lengths[order], bits, "right")]
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code += len(own)
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray, limit: int = LIMIT) -> None:
        self.lengths, self.codes, self.limit = lengths.astype(np.int64), canonical_codes(lengths), limit
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, first bit of every CHECK-th id). The first bit is the highest of the first byte."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1]) if len(ends) else 0
        words = np.zeros(total // 64 + 2, np.uint64)
        code, size = self.codes[ids], sizes.astype(np.uint64)
        word, room = starts >> 6, np.uint64(64) - (starts & 63).astype(np.uint64)
        fits = size <= room
        high = np.where(fits, code << (np.where(fits, room - size, 0).astype(np.uint64)), code >> np.where(fits, 0, size - room).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1)) if len(word) else np.empty(0, np.int64)
        if len(first):
            words[word[first]] |= np.bitwise_or.reduceat(high, first)
            over = np.flatnonzero(~fits)  # at most one for each word
            words[word[over] + 1] |= code[over] << (np.uint64(64) - (size[over] - room[over]))
        return words.astype(">u8").tobytes()[: -(-total // 8)], starts[::CHECK]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            symbols, bits = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.uint8)
            used = np.flatnonzero(self.lengths)
            used = used[np.lexsort((used, self.lengths[used]))]
            spans = 1 << (self.limit - self.lengths[used])
            symbols[: spans.sum()] = np.repeat(used, spans)
            bits[: spans.sum()] = np.repeat(self.lengths[used], spans)
            self._table = symbols, bits
        return self._table

    def decode(self, data: bytes, n: int, checks: np.ndarray) -> np.ndarray:
        """The ``n`` ids of a block, from all its checkpoints at once."""
        symbols, bits = self.table()
        out = np.zeros((len(checks), CHECK), np.uint32)
        padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
        m = len(padded) - 7
        ahead = np.zeros(m, np.uint64)  # the 64 bits from each byte on
        for k in range(8):
            ahead |= padded[k : k + m] << np.uint64(8 * (7 - k))
        at, last = checks.astype(np.int64), n - (len(checks) - 1) * CHECK
        for step in range(min(CHECK, n)):
            if step == last:
                at = at[:-1]
            if not len(at):
                break
            window = (ahead[at >> 3] << (at & 7).astype(np.uint64)) >> np.uint64(64 - self.limit)
            out[: len(at), step] = symbols[window]
            at = at + bits[window]
        return out.reshape(-1)[:n]


def _ids(tokens, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    flat, at = tokens.encode(texts)
    sizes = np.diff(at) + 1
    return np.insert(flat, at[1:], end_id), sizes


def _tokenise(path: str, end_id: int, kind: pa.DataType):
    """Rows (id, text), in order, to blocks of plain ids of 16 or 32 bits: a partition is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, shard = opened(path), TaskContext.get().partitionId()
        width = np.uint16 if max(tokens.size, end_id + 1) <= 1 << 16 else np.uint32
        block, before, keys, parts, sizes = 0, 0, [], [], []

        def flush():
            nonlocal block, before
            n = sum(map(len, parts))
            row = [[shard], [block], [before], [pa.concat_arrays(keys).to_pylist()], [np.concatenate(sizes).tolist()], [n], [np.concatenate(parts).tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            block, before = block + 1, before + n
            for x in (keys, parts, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["shard", "block", "before", "docs", "sizes", "n", "ids"])

        for batch in batches:
            for row, texts in text_chunks(batch.column(1)):
                ids, many = _ids(tokens, texts, end_id)
                keys.append(batch.column(0).slice(row, len(texts)))
                parts.append(ids.astype(width))
                sizes.append(many)
                if sum(map(len, parts)) >= BLOCK:
                    yield flush()
        if parts:
            yield flush()

    return run


def _plain(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1, np.int64)
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.bincount(_plain(raw, n), minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["id", "n"])


def _encode(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in batches:
            for i, (n, raw) in enumerate(zip(batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                bits, checks = codec.encode(_plain(raw, n))
                kept = [batch.column(c).slice(i, 1) for c in ("shard", "block", "before", "docs", "sizes", "n")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([checks.tolist()], pa.list_(pa.int64())), pa.array([bits], pa.binary())], names=["shard", "block", "before", "docs", "sizes", "n", "checks", "bits"])

    return run


def write_ids(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of each whole text, then ``end_id``, to a store at ``path``, documents in ascending order of id.

    Null ids come first; rows of one id follow each other in order of the first 32 characters of their texts, null texts
    first, and then as they stand in the table, so an id or a row that fills much of it is dealt over ranges like any other.
    Ids may be of any type that Spark orders and Arrow knows. Null and empty texts are the end id alone. An empty table
    gives a store without blocks. A store is written whole: texts are tokenised once, to a table of plain ids that counts
    and codes are made from and that goes in the end.
    """
    spark = docs.sparkSession
    prepare(spark)
    order = ["id", "head", "number"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.substring(text_col, 1, 32).alias("head"), F.monotonically_increasing_id().alias("number"))
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_kind = to_arrow_type(docs.schema[id_col].dataType)
    head = f"shard int, block int, before bigint, docs array<{kind}>, sizes array<bigint>, n bigint"
    plain = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text").mapInArrow(_tokenise(tokenizer, end_id, arrow_kind), f"{head}, ids binary"), "plain-ids", "zstd")
    counted = plain.select("n", "ids").mapInArrow(_count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    used, n = counted.column("id").to_numpy(), counted.column("n").to_numpy()
    counts = np.zeros(int(used.max(initial=-1)) + 1, np.int64)
    counts[used] = n
    lengths = code_lengths(counts)
    known = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(known.astype(np.int32)), "bits": pa.array(lengths[known].astype(np.int32))})).coalesce(1).write.parquet(f"{path}/codes")
    plain.mapInArrow(_encode(lengths), f"{head}, checks array<bigint>, bits binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    forget(plain)


def _decode(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in batches:
            docs, many, data = batch.column("docs"), batch.column("sizes"), batch.column("bits")
            for i in range(batch.num_rows):
                ids = codec.decode(data[i].as_py(), batch.column("n")[i].as_py(), np.array(batch.column("checks")[i].values))
                sizes = np.array(many[i].values)
                at = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.astype("<u4").tobytes()
                starts = batch.column("base")[i].as_py() + batch.column("before")[i].as_py() + at[:-1]
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                offsets = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [docs[i].values, pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["id", "start", "n_tokens", "ids_crc32", "ids"]
                )

    return run


def read_ids(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """Each document of the store at ``path``: id, start (ids before it), n_tokens, ids_crc32, ids (array<int>)."""
    prepare(spark)
    codes = spark.read.parquet(f"{path}/codes").toArrow()
    lengths = np.zeros(int(codes.column("id").to_numpy().max(initial=-1)) + 1, np.uint8)
    lengths[codes.column("id").to_numpy()] = codes.column("bits").to_numpy()
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = sorted(tuple(r) for r in blocks.groupBy("shard").agg(F.sum("n")).collect())
    bases, before = [], 0
    for shard, n in totals:  # one entry for each partition that was written
        bases.append((shard, before))
        before += n
    table = spark.createDataFrame(bases, "shard int, base bigint")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    rows = blocks.join(F.broadcast(table), "shard")
    return rows.select("docs", "sizes", "n", "checks", "bits", "base", "before").mapInArrow(_decode(lengths), f"{id_col} {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")
