"""Small tables with everything that may be odd about a row, and brute-force versions of what operators promise."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ["id", "key", "digest", "bands", "n", "t", "c", "grp", "links", "left", "rep", "root", "score", "rejected", "lang_pred", "piece", "_id", "_toxic", "_quern_id", "_quern_text", "kept", "n_words", "license", "toxic", "band", "hub"]
WORDS = re.compile("[^\x20\x09-\x0d]+")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "to", "mi", "re", "su", "na", "el", "or"]) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def odd_rows() -> list[tuple]:
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split(" ")
    near[60] = "changed"
    rows = [base, base, " ".join(near), None, "", "   \n\t ", "one", "one two three", "Ünïcödé ẞ ÇA 漢字 ع", prose(3, 40) + " " + passage + " " + prose(4, 40), passage + "\n" + prose(5, 30), prose(6, 20000), "\x00 nul \x01 mark", passage, "a\tb\rc\x0bd\x0ce f\x1cg h" * 3, "<|endoftext|> <|startoftext|>"]
    out = [(i, t, ["en", None, "de"][i % 3], f"s{i}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(rows)]
    return [*out, out[0], (None, base, None, None, None), (None, None, None, None, None)]


def odd(spark, clashing: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), DOCS)
    return df.select("*", *(F.lit(f"mine-{c}").alias(c) for c in CLASHING)) if clashing else df


def empty(spark):
    return odd(spark).limit(0)


def words(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def near_groups(texts: list[str | None], threshold: float = 0.8) -> tuple[list[int], list[int]]:
    """(least number of each text's group, links of each) by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], links


def pruned(texts: list[str | None], window: int = 35) -> list[tuple[int, int, str]]:
    """(words, words removed, digest of those kept) of each text."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out
