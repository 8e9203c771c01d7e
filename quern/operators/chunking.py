"""Chunks of texts, tables and formulas: table-generating functions over pages and their blocks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, stable_id
from ..session import bound_batches

SIZE, OVERLAP = 800, 150
#: After these a text may be cut; between these a table's cells stand.
_BOUNDARY = re.compile("[\n。！？.!?；;]")
CELL = " | "
CHUNK = "page int, kind string, content string, left double, right double, top double, bot double"


def effective(size: int | None, overlap: int | None) -> tuple[int, int]:
    """Size and overlap as used: a size that isn't positive is the default, an overlap not below it a quarter of it."""
    size = size if size and size > 0 else SIZE
    overlap = max(0, overlap or 0)
    return size, size // 4 if overlap >= size else overlap


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Windows of at most ``size`` characters, cut after a sentence where one ends in the last third, each beginning
    ``overlap`` characters before the end of the one before, but always further on; blank windows are left out."""
    size, overlap = effective(size, overlap)
    text = (text or "").strip(SPACES)
    ends = [m.end() for m in _BOUNDARY.finditer(text)]
    found, start = [], 0
    while start < len(text):
        stop = start + size
        if stop >= len(text):
            found.append(text[start:])
            break
        k = bisect_right(ends, stop) - 1
        cut = ends[k] if k >= 0 and ends[k] > max(stop - size // 3, start + 1) else stop
        found.append(text[start:cut])
        start = max(cut - overlap, start + 1)
    return [piece for piece in found if piece.strip(SPACES)]


def split_table(table: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Groups of whole rows under the table's header, about ``size`` characters each; a longer row stands alone.

    What has no columns, no header or no rows is split as text, so nothing of it is lost.
    """
    size, overlap = effective(size, overlap)
    header, *rest = [line.strip(SPACES) for line in table.split("\n")]
    rows = [line for line in rest if line]
    if table.count(CELL) < 2 or not header or not rows:
        return split_text(table, size, overlap)
    groups: list[list[str]] = []
    used = 0
    for row in rows:
        if not groups or used + len(row) + 1 > size:
            groups.append([])
            used = len(header)
        groups[-1].append(row)
        used += len(row) + 1
    return ["\n".join([header, *group]) for group in groups]


def split_blocks(pages: list[list[dict]], size: int = SIZE, overlap: int = OVERLAP) -> Iterator[dict]:
    """Chunks of pages of blocks: of each page first its texts, taken together, then tables and formulas in order."""
    for number, blocks in enumerate(pages, 1):
        texts = "\n\n".join(b["content"] or "" for b in blocks if b["kind"] not in ("table", "formula"))
        for piece in split_text(texts, size, overlap):
            yield {"page": number, "kind": "text", "content": piece}
        for block in blocks:
            if block["kind"] == "table":
                yield from ({"page": number, "kind": "table", "content": piece} for piece in split_table(block["content"] or "", size, overlap))
            elif block["kind"] == "formula" and (whole := (block["content"] or "").strip(SPACES)):
                yield {"page": number, "kind": "formula", "content": whole} | {k: block.get(k) for k in ("left", "right", "top", "bot")}


def split_text_udf(size: int = SIZE, overlap: int = OVERLAP):
    """A column function: text to array of chunks."""

    @F.pandas_udf("array<string>")
    def split(text: pd.Series) -> pd.Series:
        return text.map(lambda t: split_text(t, size, overlap))

    return split


def chunk_pages(pages: DataFrame, *, keys: list[str], page_col: str = "page", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of plain pages: the keys, page, pos (from 0 within the page), content."""
    bound_batches(pages.sparkSession)
    cut = split_text_udf(size, overlap)
    return pages.select(*keys, page_col, F.posexplode(cut(F.col(text_col))).alias("pos", "content"))


def chunk_documents(documents: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Chunks of documents with a column ``pages`` of blocks (array<array<struct<kind, content, left, right, top,
    bot>>>): the keys, idx (from 0 within the document), page, kind, content, box. One pass, no shuffle.

    Columns chunk_size and chunk_overlap, if there, hold for their document instead of ``size`` and ``overlap``."""
    bound_batches(documents.sparkSession)
    kept = documents.select(*keys, "pages", *((F.col(c) if c in documents.columns else F.lit(v)).cast("int").alias(f"_{c}") for c, v in (("chunk_size", size), ("chunk_overlap", overlap))))
    fields = {k: documents.schema[k].dataType.simpleString() for k in keys}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*keys, "idx", "page", "kind", "content", "left", "right", "top", "bot"]
        for pdf in batches:
            rows = []
            for record in pdf.to_dict("records"):
                pages = [list(blocks) if blocks is not None else [] for blocks in (record["pages"] if record["pages"] is not None else [])]
                head = [record[k] for k in keys]
                for idx, c in enumerate(split_blocks(pages, record["_chunk_size"], record["_chunk_overlap"])):
                    rows.append([*head, idx, c["page"], c["kind"], c["content"], *(c.get(k) for k in ("left", "right", "top", "bot"))])
            yield pd.DataFrame(rows, columns=columns)

    schema = ", ".join(f"{k} {t}" for k, t in fields.items()) + ", idx int, " + CHUNK
    return kept.mapInPandas(run, schema)


def assemble(chunks: DataFrame, *, at: Column | None = None) -> DataFrame:
    """Chunk rows as they are stored: a stable id from document, place and content."""
    return chunks.withColumn("id", stable_id(F.col("document_id"), F.col("idx"), F.col("content"))).withColumn("created_at", F.current_timestamp() if at is None else at)


def count_kinds(chunks: DataFrame, *keys: str) -> DataFrame:
    return chunks.groupBy(*keys).agg(*(F.count_if(F.col("kind") == kind).alias(f"{kind}_chunks") for kind in ("text", "table", "formula")))
