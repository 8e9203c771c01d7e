"""N-gram Jaccard join: MinHash banding, then verification on the full sets of n-grams.

1. One pass turns each text into its set of word n-grams, a digest of that set and band hashes of its MinHash
   signature. Texts of equal sets form a *class*; classes are counted before anything is shuffled by band, so
   thousands of copies are one row from here on.
2. Band hashes are shuffled with a sketch, a byte of each MinHash value. In each bucket sketches are compared, in blocks
   where it is large; pairs whose sketches agree in far less than the threshold's share (by six standard deviations) are
   no candidates. Tasks return a spanning forest of the rest, not pairs; its components are the *families* in which links
   can be. Texts that share no more than a template thus meet in buckets but make no family.
3. In each family every pair of classes is compared on its full sets by products of 0/1 matrices, in blocks of
   bounded size; a large family is dealt out over many tasks by block pair. Tasks return sums and a spanning
   forest of the links, not pairs.
4. Components of the links are the result's classes of near copies.

Words, n-grams and sets are equal where their hashes (64 bits, 64 bits, 128 bits) are: two of a million n-grams of a family
are taken for one with a chance of about 3e-8, which moves a similarity by one gram.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, free_name, gram_hashes, prepare, scan_words, text_key, utf8
from .graph import components

#: Classes and n-grams that a block of a family holds at most (one class may hold more n-grams); classes of a block of a
#: bucket, and rows of buckets that are compared at a time.
BLOCK_CLASSES, BLOCK_GRAMS, BLOCK_BUCKET, BUNDLE = 384, 400_000, 2048, 16_384
_SEED = np.random.default_rng(7)
_MULTIPLY = _SEED.integers(0, 1 << 31, 512, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _SEED.integers(0, 1 << 32, 512, dtype=np.uint32)


def bands_for(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, hence fewest false candidates, with which a pair at ``threshold`` still shares
    a band with probability ``recall`` within ``most_hashes`` hash functions."""
    if threshold >= 1:
        return 1, most_hashes
    best = (max(1, math.ceil(math.log(1 - recall) / math.log1p(-threshold))), 1)
    for rows in range(2, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted set of n-gram hashes of each text; a text of fewer words, but some, is one gram of all its words."""
    words, _, _, first = scan_words(data, offsets)
    grams = gram_hashes(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield gram_hashes(words[a:b], b - a)
        else:
            yield np.empty(0, np.uint64)


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes, a byte of each MinHash value), one row for each of the sets, none of which is empty."""
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    mins = np.empty((len(sets), bands * rows), np.uint64)
    for k in range(bands * rows):
        mins[:, k] = np.minimum.reduceat(low * _MULTIPLY[k] + _ADD[k], at)
    out = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            h = (h ^ mins[:, b * rows + r]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        out[:, b] = h
    return out.view(np.int64), (mins * np.uint64(0x9FB21C651E98DF25) >> np.uint64(56)).astype(np.uint8)


def least_agreement(threshold: float, hashes: int) -> int:
    """How many of ``hashes`` bytes of two sketches agree at least if the sets' similarity is ``threshold`` or more, but
    for a chance of about 1e-9."""
    return max(1, math.floor(hashes * threshold - 6 * math.sqrt(hashes * threshold * (1 - threshold))))


def forest(sketches: np.ndarray, group: np.ndarray, block: np.ndarray, across: np.ndarray, least: int) -> np.ndarray:
    """For each row the first row that it is joined to by pairs of one group that agree in ``least`` bytes or more.

    Rows of a group stand together. ``across``: of this group only pairs of different blocks count.
    """
    n = len(group)
    label = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, n))
    size = np.repeat(sizes, sizes)
    us, vs = [], []
    for d in range(1, min(64, int(sizes.max(initial=1)))):  # small groups all together, by distance
        u = np.flatnonzero((group[:-d] == group[d:]) & (size[:-d] <= 64))
        u = u[~across[u] | (block[u] != block[u + d])]
        u = u[(sketches[u] == sketches[u + d]).sum(1) >= least]
        us.append(u)
        vs.append(u + d)
    if us:
        u, v = np.concatenate(us), np.concatenate(vs)
        while len(u):
            low = np.minimum(label[u], label[v])
            before = label.copy()
            np.minimum.at(label, u, low)
            np.minimum.at(label, v, low)
            label = label[label]
            if (label == before).all():
                break
    for a, m in zip(first[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        own, part = np.arange(m), sketches[a : a + m]
        for lo in range(0, m, 64):
            link = (part[lo : lo + 64, None, :] == part[None, lo:, :]).sum(2) >= least
            if across[a]:
                link &= block[a + lo : a + min(lo + 64, m), None] != block[None, a + lo : a + m]
            for r in range(len(link)):
                met = np.unique(own[lo:][link[r]])
                met = np.union1d(met, own[lo + r : lo + r + 1])
                if len(met) > 1:
                    own[np.isin(own, met)] = met[0]
        label[a : a + m] = a + own
    return label


def _meet(least: int):
    """Sorted rows (band, low, high, block, digest, sketch) to ties (a, b) of digests."""

    def ties(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        key = np.stack([t.column(c).to_numpy() for c in ("band", "low", "high")], 1)
        group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]).any(1)]))
        digests = t.column("digest").combine_chunks()
        sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(group), -1)
        label = forest(sketches, group, t.column("block").to_numpy(), key[:, 1] != key[:, 2], least)
        rest = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([digests.take(pa.array(rest)), digests.take(pa.array(label[rest]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < BUNDLE:
                continue
            keys = np.stack([np.asarray(batch.column(c)) for c in range(3)], 1)
            turns = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
            if len(turns):  # groups that this batch ends are whole; its last may go on
                end = int(turns[-1]) + 1
                yield ties([*held[:-1], batch.slice(0, end)])
                held, size = [batch.slice(end)], batch.num_rows - end
        if held:
            yield ties(held)

    return run


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in chunks(offsets):
                sets = list(gram_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n))
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs, bytes_ = signatures([sets[i] for i in full], bands, rows) if full else (np.empty((0, bands), np.int64), np.empty((0, 1), np.uint8))
                sketches: list = [None] * len(sets)
                for i, x in zip(full, bytes_, strict=True):
                    sketches[i] = x.tobytes()
                has = np.zeros(len(sets), bool)
                has[full] = True
                keys: list = [digest(s) if len(s) else None for s in sets]
                at = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(sigs.ravel())), pa.array([len(s) for s in sets], pa.int32()), pa.array(sketches, pa.binary())],
                    names=["id", "key", "digest", "bands", "grams", "sketch"],
                )

    return run


def jaccard_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of sets whose Jaccard similarity is ``threshold`` or more."""
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[gram] > 1
    owner, gram = owner[shared], column[gram[shared]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    width = 2048
    for c in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
        a, b = np.searchsorted(gram, [c, c + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], gram[a:b] - c] = 1
        both += x @ x.T
    link = both * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
    np.fill_diagonal(link, False)
    return link


def _verify(n: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("digest")
        data, offsets = utf8(pa.array(pdf["text"], pa.large_string()))
        sets = [s for a, b in chunks(offsets) for s in gram_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)]
        link = jaccard_links(sets, threshold)
        block, low, high = pdf["block"].to_numpy(), int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        if low != high:
            link &= block[:, None] != block[None, :]
        root = np.arange(len(sets))
        while True:  # each takes the least number among its neighbours, until none changes
            near = np.where(link, root[None, :], len(sets)).min(axis=1)
            new = np.minimum(root, near)
            new = new[new]
            if (new == root).all():
                break
            root = new
        keys = pdf["digest"].to_numpy()
        return pd.DataFrame({"a": keys, "b": keys[root], "links": (link @ pdf["n"].to_numpy(np.int64)).astype(np.int64)})

    return run


def _linked(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(one row for each row of docs: id, key, digest), (digest, least, n_links, n_copies): ``least`` is the id and
    text key of the row of the least id among all that are linked."""
    spark = docs.sparkSession
    prepare(spark)
    bands, rows = bands_for(threshold, recall)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    first = F.struct(F.col("id").isNull().alias("nameless"), "id", "key")  # of a class the row of the least id speaks for it, null last
    signed = cut(source.mapInArrow(_sign(n, bands, rows), f"id {kind}, key binary, digest binary, bands array<bigint>, grams int, sketch binary"), "signed")
    classes = cut(signed.where("digest is not null").groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("grams").alias("grams"), F.first("sketch").alias("sketch")), "classes")
    banded = classes.select("digest", "sketch", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band", F.ceil(F.col("c") / BLOCK_BUCKET).cast("int").alias("blocks"))
    met = banded.join(buckets, "band").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "digest", "sketch")
    ties = met.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high").mapInArrow(_meet(least_agreement(threshold, bands * rows)), "a binary, b binary")
    family = cut(components(ties.distinct(), "family").join(classes.select(F.col("digest").alias("node"), "first", "n", "grams"), "node"), "families")
    sizes = family.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = family.join(cut(sizes, "sizes"), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = source.join(placed.hint("shuffle_hash"), (F.col("key") == F.col("first.key")) & F.col("id").eqNullSafe(F.col("first.id"))).select(  # texts aren't sorted
        "root", F.col("node").alias("digest"), "n", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("root", "digest", "n", "text", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    checked = cut(texts.groupBy("root", "low", "high").applyInPandas(_verify(n, threshold), "a binary, b binary, links bigint"), "checked")
    linked = components(checked.select("a", "b"), "linked").select(F.col("node").alias("digest"), "root")
    links = checked.groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    known = classes.select("digest", "first", "n").join(linked, "digest", "left").join(links, "digest", "left")
    known = known.withColumn("root", F.coalesce("root", "digest"))
    least = known.groupBy("root").agg(F.min("first").alias("least"))
    known = cut(known.join(least, "root").select("digest", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("n").alias("n_copies")), "known")
    return signed, known


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row for each row of ``docs``: id, class_id (least id among those linked to it, directly or not, or
    equal to it), n_links (other rows whose set of word n-grams has Jaccard similarity of ``threshold`` or more,
    copies included) and n_copies (rows of an equal set, itself included).

    Words are runs without ASCII white space, compared as they are. A text of 1 to n-1 words is one gram of all its
    words; a null or blank text has no gram, so it is alone: class_id its own id, no links, one copy. A null id is
    kept, counts as a link and is no one's class_id unless all ids of the class are null. Repeated rows are copies
    of each other. An empty table gives no rows; other columns are ignored. A pair at the threshold is found with
    probability ``recall`` or more; pairs that copies or other members of a family bring together are found as well.
    """
    signed, known = _linked(docs, id_col, text_col, n, threshold, recall)
    out = signed.select("id", "digest").join(known, "digest", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"),
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row of each class of near copies, all columns kept: that of the least id, null ids last, and then of the least
    digest of the text. Rows without a gram are alone and stay. Of rows of one id and text that is kept one stays; rows
    without id and gram stay all."""
    signed, known = _linked(docs, id_col, text_col, n, threshold, recall)
    own, key = free_name(docs, "_quern_id"), free_name(docs, "_quern_key")
    chosen = known.select(F.col("least.id").alias(own), F.col("least.key").alias(key)).unionByName(
        signed.where("digest is null and id is not null").select(F.col("id").alias(own), F.col("key").alias(key))
    )
    chosen = cut(chosen.distinct(), "least")
    same = lambda i, k: F.col(i).eqNullSafe(F.col(own)) & (F.col(k) == F.col(key))
    mine = free_name(docs, "_quern_text")
    kept = docs.withColumn(mine, text_key(F.col(text_col)))
    kept = kept.join(chosen.hint("shuffle_hash"), same(id_col, mine), "left_semi")
    if not signed.join(chosen, same("id", "key"), "left_semi").groupBy("id", "key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, mine])
    blank = F.col(text_col).isNull() | ~F.col(text_col).rlike("[^\\x20\\x09-\\x0D]")
    return kept.drop(mine).unionByName(docs.where(F.col(id_col).isNull() & blank))
