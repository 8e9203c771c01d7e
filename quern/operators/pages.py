"""Pages of glyphs to blocks, as DataFrames.

``pages``: document_id, page (from 1), glyphs array<struct<font, font_size, x, y, w, s>>, rects
array<struct<x0, y0, x1, y1>>.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .layout import Glyphs
from .regions import page_blocks

GLYPHS = "array<struct<font: string, font_size: double, x: double, y: double, w: double, s: string>>"
RECTS = "array<struct<x0: double, y0: double, x1: double, y1: double>>"
_BLOCKS = pa.list_(pa.struct([("kind", pa.string()), ("content", pa.string()), *((c, pa.float64()) for c in ("left", "right", "top", "bot"))]))
BLOCKS = "array<struct<kind: string, content: string, left: double, right: double, top: double, bot: double>>"


def bad_fonts(pages: DataFrame, *, share: float = 0.5) -> DataFrame:
    """(document_id, font): fonts of a document that can't be read: one of their glyphs holds a NUL, or more than
    ``share`` of them a NUL or a replacement character. Counted page by page before they are shuffled; of ``glyphs`` only
    font and s are needed."""
    bound_batches(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            glyphs = pc.list_flatten(batch.column("glyphs"))
            fields = dict(zip([f.name for f in glyphs.type], glyphs.flatten(), strict=True))
            nul, lost = (pc.match_substring(fields["s"], mark) for mark in ("\x00", "�"))
            each = pa.table({"row": pc.list_parent_indices(batch.column("glyphs")), "font": fields["font"], "nul": nul, "lost": pc.or_(nul, lost)})
            each = each.group_by(["row", "font"]).aggregate([("nul", "any"), ("lost", "sum"), ("lost", "count")]).combine_chunks()
            columns = [each[c].cast(kind) for c, kind in (("font", pa.string()), ("nul_any", pa.bool_()), ("lost_sum", pa.int64()), ("lost_count", pa.int64()))]
            found = pa.table([batch.column("document_id").take(each["row"].combine_chunks()), *columns], ["document_id", "font", "nul", "lost", "n"])
            yield from found.to_batches()

    kind = pages.schema["document_id"].dataType.simpleString()
    counted = pages.select("document_id", "glyphs").mapInArrow(count, f"document_id {kind}, font string, nul boolean, lost bigint, n bigint")
    counted = counted.groupBy("document_id", "font").agg(F.bool_or("nul").alias("nul"), F.try_divide(F.sum("lost").cast("double"), F.sum("n")).alias("lost"))
    return counted.where(F.col("nul") | (F.col("lost") > share)).select("document_id", "font")


def _glyphs(column: pa.ListArray) -> Iterator[Glyphs]:
    """The glyphs of each page, from the buffers of all: no object is made of a glyph but its strings."""
    ends, values = column.offsets.to_numpy(), column.values
    real = lambda k: values.field(k).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    text = lambda k: values.field(k).fill_null("").to_numpy(zero_copy_only=False)
    font, size, x, y, w, s = text("font"), real("font_size"), real("x"), real("y"), real("w"), text("s")
    lost = np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)) if values.null_count else np.empty(0, int)
    for n, there in enumerate(column.is_valid().to_pylist()):
        a, b = (ends[n], ends[n + 1]) if there else (0, 0)
        # a null among the glyphs is an error of its page alone
        yield None if ((lost >= a) & (lost < b)).any() else Glyphs(font[a:b], size[a:b], x[a:b], y[a:b], w[a:b], s[a:b])


def extract_blocks(pages: DataFrame, *, drop_bad_fonts: bool = True, by_width: bool = False) -> DataFrame:
    """(document_id, page, blocks, error): each page alone; a page that can't be laid out has its error instead.

    Glyphs are many times as large as their text. Where pages have a column ``bad`` (array<string>, null: none) with the
    fonts that ``bad_fonts`` finds, no glyph is shuffled; otherwise pages meet their documents' fonts in a join."""
    bound_batches(pages.sparkSession)
    rows = pages.select("document_id", "page", "glyphs", "rects")
    if drop_bad_fonts and "bad" in pages.columns:
        rows = pages.select("document_id", "page", "glyphs", "rects", "bad")
    elif drop_bad_fonts:
        fonts = bad_fonts(pages).groupBy("document_id").agg(F.collect_set("font").alias("bad"))
        rows = rows.join(fonts, "document_id", "left")
    else:
        rows = rows.withColumn("bad", F.lit(None).cast("array<string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, errors = [], []
            for page, rects, bad in zip(_glyphs(batch.column("glyphs")), batch.column("rects").to_pylist(), batch.column("bad").to_pylist(), strict=True):
                try:
                    if page is None:
                        raise TypeError("a glyph is null")
                    boxes = [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in (rects if rects is not None else [])]
                    blocks.append([b.row() for b in page_blocks(page, boxes, set(bad) if bad is not None else set(), by_width=by_width)])
                    errors.append(None)
                except Exception as error:
                    blocks.append([])
                    errors.append(f"{type(error).__name__}: {error}"[:500])
            yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("page").cast(pa.int32()), pa.array(blocks, _BLOCKS), pa.array(errors, pa.string())], ["document_id", "page", "blocks", "error"])

    kind = pages.schema["document_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"document_id {kind}, page int, blocks {BLOCKS}, error string")


def documents_of(blocks: DataFrame) -> DataFrame:
    """(document_id, pages): each document's pages of blocks in order, for chunking."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "blocks"))), lambda p: p["blocks"])
    return blocks.groupBy("document_id").agg(ordered.alias("pages"), F.max("error").alias("error"))


def page_texts(blocks: DataFrame) -> DataFrame:
    """(document_id, page, text): the page's blocks, one under the other."""
    from ..functions.text import normalize_text

    return blocks.select("document_id", "page", normalize_text(F.array_join(F.transform("blocks", lambda b: b["content"]), "\n")).alias("text"))
