"""Substring dedup: a compressed FM-index per shard, read backward for the matching statistics of streamed texts.

A window (35 words) belongs to the least hash among its 8-word grams, its *anchor*; equal windows have equal
anchors, so a window whose anchor occurs once in the corpus occurs once. That is exact, and leaves only the
neighbourhoods of repeated anchors:

1. One pass finds each text's anchors. Texts equal byte for byte are counted and one of them goes on, with its weight.
   A text is known by its digest, and in tables of places by the number of its first row: ids may repeat or be null.
2. Anchors are counted; those that occur twice or more go back to their texts, which are cut into the stretches
   that their anchors own. A physical window lies in exactly one stretch.
3. Equal stretches of a task are merged, with a count and the places where they stand. Stretches and counts go to shards
   by anchor, so all copies of a window meet; places stay behind, so a shard holds what is different, not all copies. An
   anchor that occurs very often sends each of its windows to a shard by the window's own content instead.
4. Each shard builds an FM-index over its different stretches (wavelet matrix over words, counts in suffix order) and
   reads every one of them backward, copies by their counts; windows whose longest repeated string is long enough are
   reported as intervals, which are joined to the places.
5. The words of a document that its intervals cover go.

Words are equal where their 64-bit hashes are: of n different words in a shard of which any two are equal with a chance of
2^-64, a shard of 500,000 takes two for one with a chance below 1e-8. Texts and stretches are known by 128 bits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, forget, free_name, gram_hashes, prepare, ranges, scan_words, text_key, utf8
from .fmindex import FMIndex, repeated_windows

#: Words that one shard indexes, about; occurrences from which an anchor's windows are dealt out one by one; bytes of
#: stretches and places that a task merges before it hands them on.
SHARD_WORDS, HOT, MERGED = 500_000, 1000, 8 << 20


def anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of the gram, first and last window that it owns) of each anchor of one text, in order."""
    return anchors_of(words, np.array([0, len(words)]), window, gram)[:4]


def anchors_of(words: np.ndarray, texts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of many texts, one after another, and before which anchor each text begins (with the end after the
    last). ``texts``: first word of each (with the end); places and windows are counted from the first text's first word."""
    grams = gram_hashes(words, gram)
    spread = window - gram + 1
    m = len(words) - window + 1
    if m <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none, np.zeros(len(texts), np.int64)
    low = grams.copy()
    have = 1
    while have < spread:  # least of each run of ``spread`` grams, by doubling
        step = min(have, spread - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    # windows that begin too late in their text cross into the next
    inside = np.zeros(m + 1, np.int64)
    some = np.diff(texts) >= window
    np.add.at(inside, texts[:-1][some], 1)
    np.add.at(inside, texts[1:][some] - window + 1, -1)
    inside = np.cumsum(inside)[:m] > 0
    # the leftmost gram that has the least hash: from the last window back, each is either its own first or the next's
    hit = np.full(m, -1)
    own = inside & (grams[:m] == low)
    hit[own] = np.flatnonzero(own)
    last = np.flatnonzero(inside & np.concatenate([(low[1:] != low[:-1]) | ~inside[1:], [True]]))
    late = last[hit[last] < 0]
    for k in range(spread - 1, 0, -1):
        if len(late):
            same = grams[late + k] == low[late]
            hit[late[same]] = late[same] + k
    reach = np.where(hit < 0, len(words), hit)
    at = np.minimum.accumulate(reach[::-1])[::-1]
    windows = np.flatnonzero(inside)
    at = at[windows]
    opens = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    first, final = windows[opens], windows[np.append(opens[1:], len(windows)) - 1] if len(at) else opens
    return grams[at[opens]], at[opens], first, final, np.searchsorted(first, texts)


def _find(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in chunks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words, starts, ends, first = scan_words(part, at)
                spaced, shift = joined(part, starts, ends)
                sums = [hashlib.sha256(spaced[u : max(u, v - 1)]).hexdigest() for u, v in pairwise(shift[first].tolist())]
                hashes, places, _, _, text_at = anchors_of(words, first, window, gram)
                places = places - np.repeat(first[:-1], np.diff(text_at))
                list_at = pa.array(text_at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.arange(number, number + b - a)), pa.array(np.diff(first), pa.int64()), pa.array(sums, pa.string()),
                     pa.ListArray.from_arrays(list_at, pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(list_at, pa.array(places.astype(np.int32)))],
                    names=["id", "key", "row", "n_words", "whole", "hashes", "places"],
                )
                number += b - a

    return run


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins (with the end after the last)."""
    lengths = ends - starts + 1
    out = data[np.minimum(ranges(starts, lengths), max(0, len(data) - 1))] if len(starts) else np.empty(0, np.uint8)
    at = np.concatenate([[0], np.cumsum(lengths)])
    out[at[1:] - 1] = 32
    return out, at


class _Stretches:
    """Different stretches and the places where each stands, from as many rows as MERGED bytes of stretches last."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.routes: list[int] = []
        self.cores: list[int] = []
        self.which: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.begins: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.size = 0

    def add(self, row: int, weight: int, pieces: list[bytes], routes: list[int], cores: list[int], begins: np.ndarray) -> None:
        which = []
        for piece, route, core in zip(pieces, routes, cores, strict=True):
            k = self.number.setdefault(piece, len(self.number))
            if k == len(self.cores):
                self.cores.append(core)
                self.routes.append(route)
                self.size += len(piece)
            which.append(k)
        self.which.append(np.array(which, np.int64))
        self.rows.append(np.full(len(which), row, np.int64))
        self.begins.append(begins.astype(np.int32))
        self.weights.append(np.full(len(which), weight, np.int64))
        self.size += 24 * len(which)

    def batch(self) -> pa.RecordBatch:
        of = np.concatenate(self.which)
        order = np.argsort(of, kind="stable")
        at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(self.number)))]).astype(np.int32))
        weight = np.bincount(of, np.concatenate(self.weights), len(self.number)).astype(np.int64)
        keys = [hashlib.blake2b(piece, digest_size=16).digest() for piece in self.number]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(self.routes, np.uint64).view(np.int64)), pa.array(keys, pa.binary()), pa.array(list(self.number), pa.binary()), pa.array(self.cores, pa.int32()), pa.array(weight),
                pa.ListArray.from_arrays(at, pa.array(np.concatenate(self.rows)[order])), pa.ListArray.from_arrays(at, pa.array(np.concatenate(self.begins)[order])),
            ],
            names=["route", "key", "stretch", "core", "weight", "rows", "starts"],
        )


def _anchored(data: np.ndarray, offsets: np.ndarray, rows: list[int], window: int, gram: int) -> Iterator[tuple]:
    """(row, text, first byte, byte after the last and hash of each word, ``anchors``) of these rows' texts."""
    for a, b in chunks(offsets):
        wanted = rows[bisect_left(rows, a) : bisect_left(rows, b)]
        if not wanted:
            continue
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words, starts, ends, first = scan_words(part, at)
        *found, text_at = anchors_of(words, first, window, gram)
        for i in wanted:
            u, v, x, y = first[i - a], first[i - a + 1], text_at[i - a], text_at[i - a + 1]
            hashes, *places = (f[x:y] for f in found)
            yield i, part[at[i - a] : at[i - a + 1]].tobytes(), starts[u:v] - at[i - a], ends[u:v] - at[i - a], words[u:v], (hashes, *(p - u for p in places))


def _cut(window: int, gram: int):
    """Rows (row, text, weight, places, hot) to stretches (route, key, stretch, core, weight, rows, starts).

    Equal stretches of a task are one row, or a few, with the places where they stand: what many documents share is
    merged before it is shuffled. Repeated rows bring a text again; it is taken once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held = _Stretches()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            owners, weights = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            new = []  # rows whose text was not taken before
            for i, (owner, weight) in enumerate(zip(owners, weights, strict=True)):
                if owner not in seen:
                    new.append(i)
                if weight > 1:
                    seen.add(owner)
            for i, raw, starts, ends, words, (hashes, at, first, final) in _anchored(data, offsets, new, window, gram):
                listed, hot = np.array(batch.column(3)[i].values), np.array(batch.column(4)[i].values)
                mine = np.isin(listed, at)
                where, hot = np.searchsorted(at, listed[mine]), hot[mine]
                begin, route = first[where], hashes[where]
                count = final[where] - begin + 1
                if hot.any():
                    each = np.where(hot, count, 1)
                    deal = np.repeat(hot, each)
                    begin = np.repeat(begin, each) + np.where(deal, ranges(np.zeros(len(each), np.int64), each), 0)
                    own = gram_hashes(words, window)
                    route = np.where(deal, own[begin], np.repeat(route, each))
                    count = np.where(deal, 1, np.repeat(count, each))
                    where = np.repeat(where, each)
                stop = begin + count - 1 + window
                pieces = [raw[s:e] for s, e in zip(starts[begin].tolist(), ends[stop - 1].tolist(), strict=True)]
                held.add(owners[i], weights[i], pieces, route.tolist(), (at[where] + gram - begin).tolist(), begin)
                if held.size > MERGED:
                    yield held.batch()
                    held = _Stretches()
        if held.number:
            yield held.batch()

    return run


def _search(window: int):
    """A partition is a shard: (route, key, stretch, core, weight) in, (key, begins, ends) out: the runs of words, from
    the stretch's first, that repeated windows cover. Every different stretch is read against the index of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        keys, cores, weights = [], [], []
        for batch in batches:
            for key, piece, core, weight in zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True):
                k = number.setdefault(piece, len(number))
                if k == len(cores):
                    keys.append(key)
                    cores.append(core)
                    weights.append(0)
                weights[k] += weight
        if not number:
            return
        data = np.frombuffer(b"".join(number), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in number])])
        n, weight = len(number), np.array(weights)
        del number
        hashes, firsts = [], [np.zeros(1, np.int64)]
        for a, b in chunks(offsets):
            h, _, _, first = scan_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            hashes.append(h)
            firsts.append(first[1:] + firsts[-1][-1])
        first = np.concatenate(firsts)
        _, symbol = np.unique(np.concatenate(hashes), return_inverse=True)
        del hashes, data
        sizes = np.diff(first)
        begin = first[:-1] + np.arange(n)
        text = np.zeros(len(symbol) + n, np.int32)
        text[np.arange(len(symbol)) + np.repeat(np.arange(n), sizes)] = symbol + 1
        index = FMIndex(text, weight)
        found = repeated_windows(index, text, begin, begin + sizes, begin + np.array(cores), window)
        owner = np.repeat(np.arange(n), sizes - window + 1)
        within = ranges(np.zeros(n, np.int64), sizes - window + 1)
        flags = found[begin[owner] + within]
        # runs of flagged windows of one stretch
        open_ = flags & ~np.concatenate([[False], flags[:-1] & (owner[1:] == owner[:-1])])
        close = flags & ~np.concatenate([flags[1:] & (owner[1:] == owner[:-1]), [False]])
        run_from, run_to = pa.array(within[open_].astype(np.int32)), pa.array((within[close] + window).astype(np.int32))
        run_at = np.searchsorted(owner[open_], np.arange(n + 1))
        some = np.flatnonzero(np.diff(run_at))
        for a in range(0, len(some), 20_000):
            part = some[a : a + 20_000]
            lo, hi = run_at[part[0]], run_at[part[-1] + 1]
            at = pa.array(np.append(run_at[part], hi).astype(np.int32) - np.int32(lo))  # stretches without a run add nothing between
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in part], pa.binary()), *(pa.ListArray.from_arrays(at, x.slice(lo, hi - lo)) for x in (run_from, run_to))], names=["key", "begins", "ends"])

    return run


def covered(n_words: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, begins, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks)[:n_words] > 0


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, begins, ends) to (key, text left, words removed, digest of what is left), each key once."""
    seen: set[bytes] = set()
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        keys = batch.column(0).to_pylist()
        out_keys, texts, removed, sums = [], [], [], []
        for i, key in enumerate(keys):
            if key in seen:
                continue
            seen.add(key)
            part = data[offsets[i] : offsets[i + 1]]
            _, starts, ends, _ = scan_words(part, np.array([0, len(part)]))
            gone = covered(len(starts), np.array(batch.column(2)[i].values), np.array(batch.column(3)[i].values))
            left, _ = joined(part, starts[~gone], ends[~gone])
            raw = left[:-1].tobytes()
            out_keys.append(key)
            texts.append(raw.decode())
            removed.append(int(gone.sum()))
            sums.append(hashlib.sha256(raw).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.binary()), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())], names=["key", "left", "n_removed", "sum"])


def _texts(source: DataFrame, keyed: DataFrame) -> DataFrame:
    """``keyed`` (key, rep and others) with the text of each key. Of its copies those of the least id alone come: an
    id in the join spreads copies, the key spreads the texts of an id."""
    return source.join(keyed.withColumnsRenamed({"key": "_key", "rep": "_rep"}).hint("shuffle_hash"), (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_rep")))


def _analyse(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row for each row of docs: id, key, n_words, whole), (key, row, rep, n), (key, left, n_removed, sum of the pruned)."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    found = cut(source.mapInArrow(_find(window, gram), f"id {kind}, key binary, row bigint, n_words bigint, whole string, hashes array<bigint>, places array<int>"), "anchored")
    classes = cut(found.groupBy("key").agg(F.min("row").alias("row"), F.min("id").alias("rep"), F.count("*").alias("n")), "texts")
    one = found.join(classes.select("key", "row", "n"), ["key", "row"])
    flat = one.select("row", "n", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("row", "n", F.col("x.hashes").alias("anchor"), F.col("x.places").alias("place"))
    flat = cut(flat, "anchors")
    # a text that has copies goes whole: its windows need no search, but others must find them
    counts = cut(flat.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("c")).where("n > 1").select("anchor", (F.col("c") > HOT).alias("hot")), "counts")
    back = cut(flat.select("row", "anchor", "place").join(counts, "anchor").groupBy("row").agg(F.collect_list(F.struct("place", "hot")).alias("x")), "repeated")
    forget(flat, counts)
    rows = _texts(source, back.join(classes, "row")).select("row", "text", "n", F.col("x.place").alias("places"), F.col("x.hot").alias("hots"))
    pieces = cut(rows.mapInArrow(_cut(window, gram), "route bigint, key binary, stretch binary, core int, weight bigint, rows array<bigint>, starts array<int>"), "stretches")
    # stretches that many texts share were merged by then, so shards are as many as what they index needs
    shards = max(1, -(-pieces.count() * (window + (window - gram) // 2) // SHARD_WORDS))
    # an index needs to know how often a stretch stands; where, is joined to what it has found, as often as that may be
    searched = pieces.select("route", "key", "stretch", "core", "weight").repartition(int(shards), "route").mapInArrow(_search(window), "key binary, begins array<int>, ends array<int>")
    searched = cut(searched, "found")
    placed = pieces.select("key", "rows", "starts").join(searched, "key").select(F.explode(F.arrays_zip("rows", "starts")).alias("p"), "begins", "ends")
    shifted = lambda c: F.transform(c, lambda x: x + F.col("p.starts"))
    spans = placed.select(F.col("p.rows").alias("row"), shifted("begins").alias("begins"), shifted("ends").alias("ends"))
    spans = cut(spans.groupBy("row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends"))), "spans")
    forget(back, pieces, searched)
    pruned = _texts(source, spans.join(classes, "row")).select("key", "text", "begins", "ends").mapInArrow(_prune, "key binary, left string, n_removed bigint, sum string")
    return found.select("id", "key", "n_words", "whole"), classes, pruned


def repeated_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words over it stands anywhere else in ``docs`` too, the same text included;
    windows are judged on the input, so every copy of a passage goes. Null and blank texts have no words and keep
    the digest of nothing; shorter texts than a window keep all; repeated rows are copies of one another, so their
    windows go. Other columns are ignored; an empty table gives no rows. Ids only name rows: they may be null, and
    one id may stand at several texts.
    """
    found, classes, pruned = _analyse(docs, id_col, text_col, window, gram)
    results = cut(pruned.dropDuplicates(["key"]).select("key", "n_removed", "sum"), "pruned")
    return (
        found.join(results, "key", "left")
        .select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("sum", "whole").alias("kept_sha256"))
    )


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8) -> DataFrame:
    """``docs`` with the words that ``repeated_words`` removes gone from the texts; rows of which nothing is left go.

    Texts that lose nothing stay as they are, white space included; others keep their words, one space between.
    All columns stay. A text that was blank before stays.
    """
    found, classes, pruned = _analyse(docs, id_col, text_col, window, gram)
    results = cut(pruned.dropDuplicates(["key"]).select("key", "left", "n_removed"), "pruned")
    key, own, left = (free_name(docs, f"_quern_{c}") for c in ("key", "id", "left"))
    places = found.select("id", "key").distinct().join(results.where("n_removed > 0"), "key")
    places = cut(places.select(F.col("key").alias(key), F.col("id").alias(own), F.col("left").alias(left)), "changed")
    whole = docs.join(places.hint("shuffle_hash"), (text_key(F.col(text_col)) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(own)), "left")
    out = whole.withColumn(text_col, F.when(F.col(key).isNull(), F.col(text_col)).otherwise(F.col(left))).where(F.col(key).isNull() | (F.length(left) > 0))
    return out.select(*docs.columns)
