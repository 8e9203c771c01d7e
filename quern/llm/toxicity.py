"""Toxicity by class-conditional Kneser-Ney models of how expressions are spelled.

An expression is a word (a run without ASCII white space, in lower case) as UTF-8 bytes between marks. Two interpolated
Kneser-Ney models are counted, one on toxic and one on ordinary documents: grams of ORDER bytes by their counts in the
class, shorter ones by how many different bytes stand before them there, each order and class with its own estimated
discount. From SHARED bytes down both back off to one model, the continuation counts of all documents, so a spelling
that neither class has seen speaks for neither. The log-likelihood ratio of a byte is thus that of the longest gram seen,
plus those of the back-off weights of all longer contexts. The fewer orders are the classes' own, the better held-out
documents are told (of a table of 10,000: 0.89 of the toxic ones with one, 0.78 with two, 0.62 with four): what some
thousand texts say of short grams is mostly chance.

A document is compared by length-normalised log-likelihoods: the ratio per word over the whole text, over its best windows
of 64, 16 and 4 words, and over its most toxic words, one, three and a hundredth of all, so that a long text doesn't
dilute what it holds. A logistic regression turns these means into a score; for it each labelled document is compared by
counts that have not seen it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, numbered, prepare, ranges, scan_words, utf8

#: Labelled documents of each class that are learned from, about. A text's hash picks them where there are more.
MOST_ROWS = 2_500
#: Bytes of the longest grams (at most 8), and of the longest that the classes share.
ORDER, SHARED = 8, 7
WINDOWS, TOP = (64, 16, 4), (1, 3)
#: Parts of the labelled documents: each is scored by the counts of the others to fit the scale of scores.
FOLDS = 3
FEATURES = 2 + len(WINDOWS) + len(TOP)
#: Words whose ratio a task remembers, known by 64-bit hash.
REMEMBERED = 200_000


def _table_index(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, *(np.bincount(inverse, v, len(unique)) for v in values)


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


@dataclass
class Level:
    """Log-likelihood ratios of grams of one length, and of the back-off weights of the contexts that are a byte shorter."""

    grams: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    back: np.ndarray


@dataclass
class Model:
    """Levels from ORDER bytes down to SHARED + 1, and the scale of scores."""

    levels: list[Level]
    scale: np.ndarray | None = None

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio, toxic against ordinary, of each of these words."""
        grams, owner = word_grams(data, starts, ends)
        value, left = np.zeros(len(grams)), np.arange(len(grams))
        for n, level in zip(range(ORDER, SHARED, -1), self.levels, strict=True):
            own = grams[left] & _mask(n)
            at, seen = _table_index(level.grams, own)
            value[left[seen]] += level.ratio[at[seen]]
            left, own = left[~seen], own[~seen]
            at, known = _table_index(level.contexts, own >> np.uint64(8))
            value[left[known]] += level.back[at[known]]
        return np.bincount(owner, value, len(starts))


class Words:
    """Ratios of words by hash: what was worked out is remembered, up to REMEMBERED words."""

    def __init__(self, model: Model) -> None:
        self.model, self.keys, self.ratios = model, np.empty(0, np.uint64), np.empty(0)

    def ratio(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at, known = _table_index(self.keys, hashes)
        out = np.zeros(len(hashes))
        out[known] = self.ratios[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.model.words(data, starts[new], ends[new])
            if len(self.keys) + len(new) <= REMEMBERED:
                keys = np.concatenate([self.keys, hashes[new]])
                order = np.argsort(keys, kind="stable")
                self.keys, self.ratios = keys[order], np.concatenate([self.ratios, out[new]])[order]
        return out


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All grams of ORDER bytes of the words, each with ORDER-1 zeros before and a 1 after, and the word of each."""
    lengths = ends - starts + 1
    owner = np.repeat(np.arange(len(starts)), lengths)
    place = ranges(np.zeros(len(starts), np.int64), lengths)
    padded = np.append(data, np.uint8(0))
    byte = np.where(place == lengths[owner] - 1, 1, padded[starts[owner] + place]).astype(np.uint64)
    gram = byte.copy()
    for k in range(1, ORDER):
        earlier = np.zeros(len(byte), np.uint64)
        earlier[k:] = byte[:-k] if k < len(byte) else 0
        earlier[place < k] = 0
        gram |= earlier << np.uint64(8 * k)
    return gram, owner


def discount(counts: np.ndarray) -> float:
    """Kneser and Ney's estimate n1 / (n1 + 2 n2), from how many counts are 1 and 2; 0.75 where none is."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.75


def _continuations(grams: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Before how many different bytes each of ``keys``, of n bytes, stands among ``grams``."""
    tails, many = np.unique(np.unique(grams & _mask(n + 1)) & _mask(n), return_counts=True)
    at, seen = _table_index(tails, keys)
    return np.where(seen, many[at] if len(many) else 0, 0).astype(float)


def _interpolated(counts: np.ndarray, head: np.ndarray, heads: int, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each gram, back-off weight of each context) from counts and the probabilities a byte shorter."""
    d = discount(counts)
    total, kinds = np.bincount(head, counts, heads), np.bincount(head, counts > 0, heads)
    weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    return np.maximum(counts - d, 0) / np.maximum(total, 1)[head] + weight[head] * below, weight


def fit_ratios(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """The two models' ratios from counts of each gram of ORDER bytes in either class."""
    order = np.argsort(grams)
    grams, counts = grams[order], [toxic[order].astype(float), ordinary[order].astype(float)]
    own = [grams[c > 0] for c in counts]
    levels: list[Level] = []
    shorter, below = np.zeros(1, np.uint64), [np.full(1, 1 / 256)] * 2
    for n in range(1, ORDER + 1):
        keys = np.unique(grams & _mask(n))
        heads, head = np.unique(keys >> np.uint64(8), return_inverse=True)
        at, _ = _table_index(shorter, keys & _mask(n - 1))
        if n <= SHARED:
            p, _ = _interpolated(_continuations(grams, keys, n), head, len(heads), below[0][at])
            below = [p, p]
        else:
            of_class = counts if n == ORDER else [_continuations(g, keys, n) for g in own]
            fitted = [_interpolated(c, head, len(heads), b[at]) for c, b in zip(of_class, below, strict=True)]
            below = [p for p, _ in fitted]
            ratios = [(np.log(x) - np.log(y)).astype(np.float32) for x, y in zip(*fitted, strict=True)]
            levels.insert(0, Level(keys, ratios[0], heads, ratios[1]))
        shorter = keys
    return Model(levels)


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array([t.lower() if t else "" for t in texts.to_pylist()], pa.large_string()))


def _unique_words(data: np.ndarray, offsets: np.ndarray):
    words, starts, ends, first = scan_words(data, offsets)
    hashes, sample, inverse = np.unique(words, return_index=True, return_inverse=True)
    return hashes, starts[sample], ends[sample], inverse, first


def features(words: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text the mean ratio per word: of all, of its best window of each of WINDOWS, of the most toxic words, as many
    as each of TOP and a hundredth; and 1."""
    hashes, starts, ends, inverse, first = _unique_words(data, offsets)
    value = words.ratio(hashes, data, starts, ends)[inverse] if len(inverse) else np.empty(0)
    sums = np.concatenate([[0], np.cumsum(value)])
    out = np.zeros((len(offsets) - 1, FEATURES + 1))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if n := b - a:
            out[i, 0] = (sums[b] - sums[a]) / n
            for k, window in enumerate(WINDOWS, 1):
                w = min(window, n)
                out[i, k] = (sums[a + w : b + 1] - sums[a : b - w + 1]).max() / w
            most = np.sort(value[a:b])[::-1]
            for k, top in enumerate((*TOP, 2 + n // 100), 1 + len(WINDOWS)):
                out[i, k] = most[:top].mean()
    out[:, FEATURES] = 1
    return np.clip(out, -30, 30)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic, fold) to counts of grams: (gram, fold, toxic, ordinary)."""
    for batch in batches:
        data, offsets = _lowered(batch.column(0))
        toxic, fold = np.array(batch.column(1).to_pylist(), float), np.array(batch.column(2).to_pylist())
        for a, b in chunks(offsets):
            part = data[offsets[a] : offsets[b]]
            _, starts, ends, inverse, first = _unique_words(part, offsets[a : b + 1] - offsets[a])
            if not len(starts):
                continue
            grams, owner = word_grams(part, starts, ends)
            for k in range(FOLDS):
                own, label = (np.repeat(x, np.diff(first)) for x in (fold[a:b] == k, toxic[a:b]))
                many = [np.bincount(inverse, own * x, len(starts))[owner] for x in (label, 1 - label)]
                held = (many[0] > 0) | (many[1] > 0)
                keys, yes, no = _sum_by(grams[held], many[0][held], many[1][held])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), k, np.int32)), pa.array(yes.astype(np.int64)), pa.array(no.astype(np.int64))], names=["gram", "fold", "toxic", "ordinary"])


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Words(m) for m in shared.value]
        for batch in batches:
            data, offsets = _lowered(batch.column(0))
            fold = np.array(batch.column(2).to_pylist())
            for a, b in chunks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                every = np.stack([features(m, part, at) for m in models])
                x = every[fold[a:b], np.arange(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(x[:, k].copy()) for k in range(FEATURES)] + [batch.column(1).slice(a, b - a).cast(pa.int32())], names=[*(f"x{k}" for k in range(FEATURES)), "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    pull = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> Model | None:
    """A model from the documents that ``labels`` (id, 0 or 1) marks; None where a class has no document with a word.

    Null ids and labels don't count; an id with several labels is toxic if one says so. Of a class with more than
    ``most_rows`` labels about that many are taken, by a hash of their ids: that bounds the model, the rows that are
    broadcast here, and the driver's memory. The counts themselves are summed on the executors.
    """
    spark = docs.sparkSession
    prepare(spark)
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    sizes = {r["_toxic"]: r["n"] for r in marked.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    share: Column = F.when(F.col("_toxic") == 1, F.lit(most_rows / sizes[1])).otherwise(F.lit(most_rows / sizes[0]))
    taken = marked.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(taken), "_id").select("text", "_toxic")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(FOLDS)).cast("int"))
    counted = rows.mapInArrow(_count, "gram bigint, fold int, toxic bigint, ordinary bigint").groupBy("gram", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    table = counted.toArrow()
    grams, part, *counts = (table.column(k).to_numpy() for k in range(4))
    grams = grams.view(np.uint64)
    del table
    if not (counts[0].any() and counts[1].any()):
        return None
    model = fit_ratios(*_sum_by(grams, *counts))
    others = [fit_ratios(*_sum_by(grams[part != k], *(c[part != k] for c in counts))) for k in range(FOLDS)]
    shared = spark.sparkContext.broadcast(others)
    seen = rows.mapInArrow(_features(shared), ", ".join(f"x{k} double" for k in range(FEATURES)) + ", toxic int").toArrow()
    x = np.stack([*(seen.column(k).to_numpy() for k in range(FEATURES)), np.ones(seen.num_rows)], 1)
    model.scale = _logistic(x, seen.column(FEATURES).to_numpy().astype(float))
    shared.destroy()
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Words(model)
        for batch in batches:
            data, offsets = _lowered(batch.column(batch.num_columns - 1))
            scores = [1 / (1 + np.exp(-np.clip(features(words, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) @ model.scale, -30, 30))) for a, b in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.empty(0))], names=[*batch.schema.names[:-1], "score"])

    return run


def toxicity(docs: DataFrame, model: Model | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, from 0 to 1, of each whole text; higher: likelier toxic.

    Null and blank texts have no word and get what the scale gives to nothing; without a model all get 0. Repeated
    rows get equal scores. Columns of any name and type pass through, but for one named ``score_col``.
    """
    prepare(docs.sparkSession)
    if model is None:
        return docs.drop(score_col).withColumn(score_col, F.lit(0.0))
    kept = [c for c in docs.columns if c != score_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, schema = numbered(docs, kept, text_col)
    return rows.mapInArrow(_score(shared), f"{schema}score double").toDF(*kept, score_col)


def in_fold(id_col: str, of: int, held: int) -> Column:
    """Is crc32 of the id, as text, ``held`` modulo ``of``? A null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == held, F.lit(False))
