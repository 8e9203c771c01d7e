"""Language identification by nearest centroid: normalised TF-IDF vectors of character n-grams against several
clustered centroids of each language, by cosine, with rejection by distance.

Letters in lower case, with one blank for each run of anything else, give n-grams of 1 to 3 characters, hashed to a
fixed number of components. Inverse document frequencies are counted over all documents that may be learned from;
centroids are clustered (spherical k-means) on a bounded number of documents of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, prepare
from .tokens import text_chunks

#: Components of a vector; longest n-gram; documents of each language to cluster, about; centroids of each language.
SIZE, LONGEST, MOST_ROWS, CLUSTERS = 4096, 3, 400, 4
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the hashed n-grams of each text, whether each has a letter)."""
    letters = letter_table()
    out, has = np.zeros((len(texts), SIZE), np.float32), np.zeros(len(texts), bool)
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.zeros(begin[-1] + LONGEST, np.uint32)
    for c, a in zip(codes, begin[:-1].tolist(), strict=True):
        flat[a + 1 : a + 1 + len(c)] = c
    is_letter = letters[flat]
    flat[~is_letter] = 0
    keep = is_letter | np.concatenate([[True], is_letter[:-1]])  # one blank for each run
    keep[begin[:-1]] = True
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    kept = keep[: begin[-1]]
    owner, flat = owner[kept], flat[: begin[-1]][kept].astype(np.uint64)
    m = len(flat)
    h = np.zeros(m, np.uint64)
    for n in range(1, LONGEST + 1):
        v = m - n + 1
        if v <= 0:
            break
        h = (h[:v] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1 :] + np.uint64(1)) if n > 1 else flat + np.uint64(1)
        mixed = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 12)
        good = (owner[:v] == owner[n - 1 :]) & ((flat[:v] > 0) | (flat[n - 1 :] > 0))
        out += np.bincount(owner[:v][good] * SIZE + mixed[good].astype(np.int64), minlength=len(texts) * SIZE).reshape(len(texts), SIZE)
    np.logical_or.at(has, owner[flat > 0], True)
    return out, has


def gram_components(gram: str) -> int:
    """The component of one n-gram, in which a blank stands for a run of what is no letter."""
    h = 0
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + (0 if c == " " else ord(c)) + 1) % (1 << 64)
    return h * 0xBF58476D1CE4E5B9 % (1 << 64) >> (64 - 12)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    for a in range(0, len(texts), 128):
        yield a, texts[a : a + 128]


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    #: Greatest distance (1 - cosine) from each centroid that is not rejected.
    reach: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine with its nearest centroid from 0 to 1, rejected for its distance) of each text."""
        names: list[str] = []
        scores, far = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for a, part in _blocks(texts):
            counts, has = gram_counts(part)
            near = vectors(counts, self.idf) @ self.centroids.T
            best = near.argmax(1)
            score = np.clip(near[np.arange(len(part)), best], 0, 1)
            scores[a : a + len(part)] = np.where(has, score, 0)
            far[a : a + len(part)] = ~has | (1 - score > self.reach[best])
            names += [self.languages[self.owner[b]] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        return names, scores, far


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, rows = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for _, texts in text_chunks(batch.column(0)):
            for _, part in _blocks(texts):
                counts, _ = gram_counts(part)
                found += (counts > 0).sum(0)
                rows += len(part)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, SIZE), pa.int32()), pa.array(np.concatenate([[rows], found]))], names=["gram", "n"])


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_chunks(batch.column(0)):
                for a, part in _blocks(texts):
                    x = vectors(gram_counts(part)[0], idf).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), batch.column(1).slice(row + a, len(part))], names=["x", "lang"])

    return run


def cluster(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means from the points farthest from each other; empty clusters go."""
    centroids = [x.mean(0)]
    for _ in range(k - 1):
        centroids.append(x[np.argmin(np.max(x @ np.array(centroids).T, axis=1))])
    c = np.array(centroids)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == j].mean(0) for j in range(len(c)) if (near == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS, clusters: int = CLUSTERS) -> Model | None:
    """A model of the languages of ``docs``; rows of null language count only for document frequencies, and null texts
    not at all. None if no text has a language.

    Of a language of more than ``most_rows`` different texts about that many are clustered, by a hash of the text, each
    once however many copies it has: that bounds the driver's memory and leaves no language to its copies. The number of
    languages is taken to be small.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    key = F.xxhash64("text", F.lit(11))
    sizes = {r["lang"]: r["n"] for r in rows.where("lang is not null").groupBy("lang").agg(F.approx_count_distinct(key).alias("n")).collect()}
    if not sizes:
        return None
    counted = rows.select("text").mapInArrow(_frequencies, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SIZE + 1)
    n[counted.column("gram").to_numpy() + 1] = counted.column("n").to_numpy()
    idf = np.log((1 + n[0]) / (1 + n[1:])) + 1
    share = F.lit(0.0)
    for lang, count in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, most_rows / count))).otherwise(share)
    taken = rows.where("lang is not null").where(F.pmod(key, F.lit(1 << 20)) < share * (1 << 20))
    taken = taken.groupBy("lang", key.alias("key")).agg(F.first("text").alias("text"))  # a copy is left of a text in each task before any is sent
    table = taken.select("text", "lang").mapInArrow(_vectors(idf), "x binary, lang string").toArrow()
    langs = np.array(table.column("lang").to_pylist(), object)
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float16).reshape(-1, SIZE).astype(np.float32)
    full = np.linalg.norm(x, axis=1) > 0
    langs, x = langs[full], x[full]
    names = sorted(set(langs))
    if not names:
        return None
    order = np.lexsort(x[:, :8].T)
    langs, x = langs[order], x[order]
    groups = [cluster(x[langs == name], min(clusters, int((langs == name).sum()))) for name in names]
    centroids = np.concatenate(groups)
    owner = np.repeat(np.arange(len(names)), [len(g) for g in groups])
    near = x @ centroids.T
    best = near.argmax(1)
    distance = 1 - near[np.arange(len(x)), best]
    reach = np.array([np.quantile(distance[best == j], 0.995) + 0.05 if (best == j).any() else 1.0 for j in range(len(centroids))])
    return Model(names, centroids, owner, idf, reach)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            kept, texts = batch.columns[:-1], batch.column(batch.num_columns - 1)
            for row, part in text_chunks(texts):
                names, scores, far = model.predict(part)
                yield pa.RecordBatch.from_arrays([*(c.slice(row, len(part)) for c in kept), pa.array(names), pa.array(scores), pa.array(far)], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected (too far from any centroid) of each whole text.

    Null texts and texts without a letter are ``und``, score 0, rejected; so are all without a model. lang_pred names
    the nearest language even where rejected says not to trust it. Columns of those three names are replaced, others
    pass through; repeated rows fare alike.
    """
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    if model is None:
        return docs.select(*kept).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, schema = numbered(docs, kept, text_col)
    return rows.mapInArrow(_predict(shared), f"{schema}lang_pred string, score double, rejected boolean").toDF(*kept, "lang_pred", "score", "rejected")
