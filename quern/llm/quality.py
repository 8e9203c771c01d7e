"""Quality rules as a short-circuit cascade, in native expressions alone.

Rules are conditions that reject a text. On a sample, drawn row by row from all partitions, the JVM's clock is read
before and after each rule of each row; rules are then put in order of rejections per second. A nested CASE asks the next
rule only for texts that no rule before has rejected. A text's verdict is the same in any order, so the estimate can
change the speed of a run but never its rows.

Words are ``[^\\x20\\x09-\\x0D]+``; all counts are of whole texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, BLANK, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
#: Reads no further than the tenth word.
TEN_WORDS = r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){9}[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SYMBOLS, "")).cast("bigint")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))


def n_repeat_words(found: Column, n: int = 5) -> Column:
    """Words in windows of ``n`` words that stand in the text twice or more. ``found``: its words.

    Hashes of the windows settle texts without a repeat: equal windows have equal hashes. For others the windows
    themselves are sorted, equal neighbours marked, and the words that marked windows cover counted.
    """

    def windows(w: Column, make: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), make)

    def exact(w: Column) -> Column:
        ordered = F.array_sort(windows(w, lambda i: F.struct(F.array_join(F.slice(w, i, n), " ").alias("s"), i.alias("i"))))

        def marked(o: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(o, a)["s"] == F.get(o, b)["s"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.array_sort(F.transform(twice, lambda k: F.get(o, k)["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        step = lambda acc, i: F.struct((i + n).alias("end"), (acc["sum"] + F.least(F.lit(n), i + n - acc["end"])).alias("sum"))
        return F.aggregate(let(ordered, marked), start, step, lambda acc: acc["sum"])

    def gate(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        rows = lambda h: F.arrays_zip(*(F.slice(h, k + 1, F.size(h) - (n - 1)) for k in range(n)))
        return let(F.transform(let(hashed, rows), lambda r: F.xxhash64(r)), lambda h: F.size(F.array_distinct(h)) < F.size(h))

    return let(found, lambda w: F.when(F.size(w) <= n, F.lit(0)).otherwise(F.when(gate(w), exact(w)).otherwise(F.lit(0)))).cast("bigint")


def counts(text: Column) -> Column:
    """All counts of a text, as a struct: n_words, word_chars, n_repeat_words, n_symbols, n_lines (with a word) and
    n_dup_lines. Each is worked out once."""
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), n_repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines(text), lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    whole = F.struct(of_words.alias("w"), of_lines.alias("l"), n_symbols(text).alias("n_symbols"))
    return let(whole, lambda c: F.struct(*(c["w"][x].alias(x) for x in ("n_words", "word_chars", "n_repeat_words")), c["n_symbols"].alias("n_symbols"), *(c["l"][x].alias(x) for x in ("n_lines", "n_dup_lines"))))


@dataclass(frozen=True)
class Rule:
    """Rejects where ``test(text)`` is true. ``counted`` says the same of the struct of ``counts``, where that can."""

    name: str
    test: Callable[[Column], Column] = field(compare=False)
    counted: Callable[[Column], Column] | None = field(default=None, compare=False)


#: Share of symbols among characters of words, of repeated lines among lines, least and most mean length of a word.
MOST_SYMBOLS, MOST_DUP_LINES, LEAST_MEAN, MOST_MEAN = 0.15, 0.5, 2, 15


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANK, ""))


def _dup_line_share(text: Column) -> Column:
    return let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))) > F.size(x) * F.lit(MOST_DUP_LINES))


#: The base rules come first in the contract; all are cheap to state alone, so the cascade may ask any of them first.
RULES = [
    Rule("few_words", lambda t: ~F.rlike(t, F.lit(TEN_WORDS)), lambda c: c["n_words"] < 10),
    Rule("repeated_words", lambda t: let(words(t), lambda w: n_repeat_words(w) * 100 > F.size(w) * 20), lambda c: c["n_repeat_words"] * 100 > c["n_words"] * 20),
    Rule("symbols", lambda t: n_symbols(t) > _word_chars(t) * F.lit(MOST_SYMBOLS), lambda c: c["n_symbols"] > c["word_chars"] * F.lit(MOST_SYMBOLS)),
    Rule("repeated_lines", _dup_line_share, lambda c: c["n_dup_lines"] > c["n_lines"] * F.lit(MOST_DUP_LINES)),
    Rule(
        "word_length", lambda t: let(F.struct(F.size(words(t)).alias("n"), _word_chars(t).alias("c")), lambda x: (x["c"] < x["n"] * LEAST_MEAN) | (x["c"] > x["n"] * MOST_MEAN)),
        lambda c: (c["word_chars"] < c["n_words"] * LEAST_MEAN) | (c["word_chars"] > c["n_words"] * MOST_MEAN),
    ),
    # a small ASCII letter settles most texts at their first word
    Rule("one_case", lambda t: ~F.rlike(t, F.lit("[a-z]")) & (F.upper(t) == t) & (F.lower(t) != t)),
]


def _now() -> Column:
    """The JVM's clock in nanoseconds, read anew for each row and place."""
    return F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("bigint")


def estimate(rows: DataFrame, conditions: list[Column], sample_rows: int, *, given: dict[str, Column] | None = None) -> list[tuple[float, float]]:
    """(share of rows that it rejects, mean nanoseconds) of each condition, on about ``sample_rows`` rows of all partitions.
    ``given``: columns that conditions read, worked out on the sample before the clock runs.

    One pass: partitions send sums, not rows. An empty sample gives (0, 0).
    """
    share = min(1.0, sample_rows / max(1, rows.count()))
    fields = [_now().alias("at0")]
    for k, c in enumerate(conditions):  # fields of a struct are worked out in order
        fields += [F.coalesce(c, F.lit(False)).alias(f"hit{k}"), _now().alias(f"at{k + 1}")]
    timed = rows.sample(share, seed=17).withColumns(given or {}).select(F.struct(*fields).alias("x"))
    sums = [F.count("*")]
    for k in range(len(conditions)):
        sums += [F.count_if(F.col(f"x.hit{k}")), F.sum(F.col(f"x.at{k + 1}") - F.col(f"x.at{k}"))]
    n, *found = timed.agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).first()
    return [((a or 0) / max(1, n), (b or 0) / max(1, n)) for a, b in zip(found[::2], found[1::2], strict=True)]


def _ordered(rules: list[Rule], found: list[tuple[float, float]], sample_rows: int) -> list[Rule]:
    gain = [(share + 0.5 / sample_rows) / max(1.0, nanos) for share, nanos in found]
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain[k], k))]


def order_rules(docs: DataFrame, rules: list[Rule] | None = None, *, text_col: str = "text", sample_rows: int = 1000) -> list[Rule]:
    """``rules`` by rejections per second on about ``sample_rows`` texts of ``docs``, most first; ties keep their order."""
    rules = RULES if rules is None else rules
    rows = docs.select(F.coalesce(text_col, F.lit("")).alias("t"))
    return _ordered(rules, estimate(rows, [r.test(F.col("t")) for r in rules], sample_rows), sample_rows)


def verdict(text: Column, rules: list[Rule], counted: Column | None = None) -> Column:
    """Name of the first of ``rules`` that rejects, null if none does. Null texts are empty. ``counted``: a struct of
    ``counts``, which spares the rules that it settles the text."""
    whole = F.coalesce(text, F.lit(""))
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(_form(rule, whole, counted), F.lit(rule.name)).otherwise(out)
    return out


def _form(rule: Rule, text: Column, counted: Column | None) -> Column:
    return rule.test(text) if counted is None or rule.counted is None else rule.counted(counted)


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, *, text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, in any order of the rules; columns stay as they are.

    Null and blank texts have no words and go. Repeated rows fare alike; an empty table stays empty.
    """
    ordered = order_rules(docs, rules, text_col=text_col, sample_rows=sample_rows)
    return docs.where(verdict(F.col(text_col), ordered).isNull())


def quality(docs: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """Counts and verdict of each row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rejected_by (the method's rule among those asked, null where kept or the base failed).

    Null texts have no words: all counts 0, base_failed. Repeated rows fare alike; ids may be null; other columns
    are ignored. The counts are wanted for every row and worked out once; the cascade is asked only where the base has
    passed, of the counts where they settle a rule and of the text where they don't, in the order that these forms earn.
    """
    rules = [r for r in (RULES if rules is None else rules) if r.name not in ("few_words", "repeated_words")]
    rows = docs.select(F.col(id_col).alias("_quern_id"), F.coalesce(text_col, F.lit("")).alias("t"))
    counted = rows.withColumn("c", counts(F.col("t")))
    found = estimate(rows.select("t"), [_form(r, F.col("t"), F.col("c")) for r in rules], sample_rows, given={"c": counts(F.col("t"))})
    failed = (F.col("c.n_words") < 10) | (F.col("c.n_repeat_words") * 100 > F.col("c.n_words") * 20)
    by = F.when(~failed, verdict(F.col("t"), _ordered(rules, found, sample_rows), F.col("c")))
    judged = counted.select("_quern_id", "c", failed.alias("failed"), by.alias("by"))
    return judged.select(
        F.col("_quern_id").alias(id_col), *(F.col(f"c.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("failed").alias("base_failed"), (~F.col("failed") & F.col("by").isNull()).alias("kept"), F.col("by").alias("rejected_by"),
    )
