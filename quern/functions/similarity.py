"""Similarity and ranking functions, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The constant of reciprocal-rank fusion; text rank's weight of a lexeme without a label and the sum
#: that limits repeats of one term.
RRF_K = 60
LEXEME_WEIGHT, REPEAT_LIMIT = 0.1, 1.64493406685
#: Places of one lexeme that count, and the last place in a text; later ones count as that one.
MOST_PLACES, LAST_PLACE = 256, 16382


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for null, empty or zero vectors and for vectors of different lengths."""
    size = norm(a) * norm(b)
    good = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(good & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the lower-case alphanumeric words, each after two blanks and before one."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared elements of all elements of two arrays without repeats; 0 for two empty ones. Each is worked out once."""

    def share(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda both: F.when(F.size(x) + F.size(y) > both, both / (F.size(x) + F.size(y) - both)).otherwise(F.lit(0.0)))

    return let(a, lambda x: let(b, lambda y: share(x, y)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared 3-grams of all 3-grams of two texts; null texts have none."""
    return set_similarity(trigrams(F.coalesce(a, F.lit(""))), trigrams(F.coalesce(b, F.lit(""))))


def matches_all(tokens: Column, wanted: Column) -> Column:
    """Does ``tokens`` hold each of ``wanted``? Nothing wanted matches nothing."""
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, tokens)) == 0)


def _near(distance: Column) -> Column:
    return F.when(distance > 100, F.lit(1e-30)).otherwise(1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2)))


def counted_places(hits: Column) -> Column:
    """The places that a text vector keeps, in order of term and place."""
    kept = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.struct(h["t"].alias("t"), F.least(h["p"], F.lit(LAST_PLACE)).alias("p")))))
    return let(kept, lambda x: F.filter(x, lambda h, i: (i < MOST_PLACES) | (F.get(x, i - MOST_PLACES)["t"] != h["t"])))


def ts_rank(hits: Column) -> Column:
    """Text rank of the places where a query's terms stand: ``hits`` is array<struct<t string, p int>>.

    One term: its weight by the sum of inverse squares of its repeats' numbers. More: all pairs of places of
    different terms, nearer pairs weighing more, combined as independent chances. There is no inverse document
    frequency and no normalisation by length. Only the first MOST_PLACES of a term count, which bounds the pairs.
    """

    def pairs(kept: Column, hit: Column) -> Column:
        others = F.filter(kept, lambda o: (o["t"] > hit["t"]) & (o["p"] != hit["p"]))
        return F.aggregate(others, F.lit(1.0), lambda s, o: s * (1 - F.sqrt(LEXEME_WEIGHT * LEXEME_WEIGHT * _near(F.abs(o["p"] - hit["p"])))))

    def rank(kept: Column) -> Column:
        single = F.aggregate(F.sequence(F.lit(1), F.size(kept)), F.lit(0.0), lambda s, j: s + 1.0 / (j * j)) * (LEXEME_WEIGHT / REPEAT_LIMIT)
        many = 1 - F.aggregate(kept, F.lit(1.0), lambda s, h: s * pairs(kept, h))
        terms = F.size(F.array_distinct(F.transform(kept, lambda h: h["t"])))
        return F.when(F.size(kept) == 0, F.lit(0.0)).when(terms == 1, single).otherwise(many)

    return let(counted_places(hits), rank)


def token_hits(tokens: Column, wanted: Column) -> Column:
    """The places in ``tokens`` of the ``wanted``, for ``ts_rank``."""
    numbered = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.cast("int").alias("p")))
    return F.filter(numbered, lambda h: F.array_contains(wanted, h["t"]))


def rrf(rank: Column) -> Column:
    return 1.0 / (RRF_K + rank)
