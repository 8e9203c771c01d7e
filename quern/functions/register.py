"""SQL names for the functions: temporary SQL functions where Catalyst has all it needs, a table function for chunks."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import split_text
from .similarity import LAST_PLACE, LEXEME_WEIGHT, MOST_PLACES, REPEAT_LIMIT, RRF_K

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS DOUBLE) * cast(y AS DOUBLE)), 0D, (s, v) -> s + v)"


class SplitText:
    """TABLE(split_text(text, size, overlap)): pos, content."""

    def eval(self, text: str, size: int, overlap: int):
        yield from enumerate(split_text(text, size, overlap))


def register(spark: SparkSession) -> None:
    """cosine_sim(a, b), trgm_similarity(a, b), rrf(rank), ts_rank_simple(tokens, wanted) and the table function
    split_text(t, size, overlap)."""
    dot, aa, bb = _DOT.format(a="a", b="b"), _DOT.format(a="a", b="a"), _DOT.format(a="b", b="b")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_sim(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        f"CASE WHEN size(a) = size(b) AND size(a) > 0 AND {aa} > 0 AND {bb} > 0 THEN {dot} / (sqrt({aa}) * sqrt({bb})) ELSE 0D END"
    )
    grams = "array_distinct(flatten(transform(regexp_extract_all(lower({t}), '[\\\\p{{L}}\\\\p{{N}}]+', 0), w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))"
    a, b = grams.format(t="a"), grams.format(t="b")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION trgm_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN coalesce(size(array_intersect({a}, {b})) / nullif(size(array_union({a}, {b})), 0), 0D)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rrf(rank INT) RETURNS DOUBLE RETURN 1D / ({RRF_K} + rank)")
    kept = f"array_sort(array_distinct(filter(transform(tokens, (t, i) -> struct(lower(t) AS t, least(i, {LAST_PLACE}) AS p)), h -> array_contains(wanted, h.t))))"
    hits = f"element_at(transform(array({kept}), x -> filter(x, (h, i) -> i < {MOST_PLACES} OR get(x, i - {MOST_PLACES}).t <> h.t)), 1)"
    near = "CASE WHEN abs(o.p - h.p) > 100 THEN 1e-30D ELSE 1D / (1.005D + 0.05D * exp(abs(o.p - h.p) / 1.5D - 2D)) END"
    single = f"aggregate(sequence(1, size(hs)), 0D, (s, j) -> s + 1D / (j * j)) * {LEXEME_WEIGHT / REPEAT_LIMIT}D"
    many = f"1D - aggregate(hs, 1D, (s, h) -> s * aggregate(filter(hs, o -> o.t > h.t AND o.p <> h.p), 1D, (a, o) -> a * (1D - sqrt({LEXEME_WEIGHT * LEXEME_WEIGHT}D * ({near})))))"
    rank = f"CASE WHEN size(hs) = 0 THEN 0D WHEN size(array_distinct(transform(hs, h -> h.t))) = 1 THEN {single} ELSE {many} END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ts_rank_simple(tokens ARRAY<STRING>, wanted ARRAY<STRING>) RETURNS DOUBLE RETURN element_at(transform(array({hits}), hs -> {rank}), 1)")
    spark.udtf.register("split_text", F.udtf(SplitText, returnType="pos int, content string"))
