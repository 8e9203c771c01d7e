"""Best-fit packing of token sequences, improved by swap-based local search.

Pieces are numbered as they are written and dealt by number into groups of bounded size. Each group is packed by best
fit, longest first, then improved: pieces move from emptier to fuller bins, or one or two are exchanged for one or two,
whenever that raises the sum of squared fills, until bins run empty or no such step is left. What stands in clearly underfull bins goes on to a
round of fewer groups, till one is left or a round places less than a quarter of its pieces: what is then left hardly
fits together, and the bins of that round are final. So rounds end, and what is wasted beyond what the lengths
themselves forbid is a fraction of one bin for each group of thousands.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, prepare
from .tokens import opened, text_chunks

#: Pieces of a group, about. Bins with at least 1/SLACK of their room free go on to the next round.
GROUP, SLACK = 4096, 64
#: Least share of its pieces that a round has to place for another to follow. Bins of so many items offer pairs too.
PROGRESS, PAIRED = 0.25, 6


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, by best fit from the longest item on. No length may exceed ``capacity``."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        fits = rooms >> size
        if fits and size:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        by_room[room - size].append(b)
        if room - size:
            rooms |= 1 << (room - size)
    return bins


class Offers:
    """What bins could give back: nothing, an item or, from bins of few items, two. One column of ``table`` for each:
    its length, the length that may come for it, the fill of its bin (-1: no longer true) and its bin."""

    def __init__(self, bins: list[list[int]], fill: list[int], lengths: list[int], capacity: int) -> None:
        self.bins, self.fill, self.lengths, self.capacity = bins, fill, lengths, capacity
        self.table, self.items, self.end = np.zeros((4, 0), np.int64), [], 0
        self.at = [(0, 0)] * len(bins)
        for b in range(len(bins)):
            self.renew(b)

    def renew(self, b: int) -> None:
        lo, hi = self.at[b]
        self.table[2, lo:hi], self.table[:2, lo:hi], self.at[b] = -1, 0, (0, 0)
        room = self.capacity - self.fill[b]
        if not 0 < room < self.capacity:
            return
        own = self.bins[b]
        new = [(), *((i,) for i in own), *(combinations(own, 2) if len(own) <= PAIRED else ())]
        if self.end + len(new) > self.table.shape[1]:
            self._compact()
        lo, hi = self.end, self.end + len(new)
        back = np.array([sum(self.lengths[i] for i in x) for x in new])
        self.table[:, lo:hi] = back, back + room, np.full(len(new), self.fill[b]), np.full(len(new), b)
        self.items += new
        self.at[b], self.end = (lo, hi), hi

    def _compact(self) -> None:
        true = np.flatnonzero(self.table[2, : self.end] >= 0)
        table = np.zeros((4, 2 * len(true) + 4096), np.int64)
        table[:, : len(true)] = self.table[:, true]
        moved = np.zeros(self.end + 1, np.int64)
        moved[true] = np.arange(len(true))
        self.at = [(int(moved[lo]), int(moved[lo]) + hi - lo) if hi > lo else (0, 0) for lo, hi in self.at]
        self.table, self.items, self.end = table, [self.items[i] for i in true], len(true)


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty bins by moves that raise the sum of squared fills, until as few are left as the sum of lengths needs or
    no move, exchange of one for one, of two for one or two, or of one for two raises it.

    From the emptiest bin on, everything that could leave it (one or two items) is held at once against everything
    that could come back from any bin at least as full (nothing, one or two items); the step that fills a bin most is
    taken. A step costs a few passes over one array of offers. A bin without a step rests until the others are through.
    """
    least = -(-sum(lengths) // capacity)
    full = [list(b) for b in bins if sum(lengths[i] for i in b) >= capacity]
    bins = [list(b) for b in bins if sum(lengths[i] for i in b) < capacity]
    fill = [sum(lengths[i] for i in b) for b in bins]
    offers, left, marks = Offers(bins, fill, lengths, capacity), len(full) + len(bins), np.zeros(capacity + 1, np.int64)
    steps = True
    while steps and left > least:
        steps = False
        queue = [(f, b) for b, f in enumerate(fill) if 0 < f < capacity]
        heapq.heapify(queue)
        while queue and left > least:
            f, a = heapq.heappop(queue)
            while f == fill[a] > 0:
                own = bins[a]
                leaving = {lengths[i] + lengths[j]: (i, j) for i, j in combinations(own, 2)} | {lengths[i]: (i,) for i in own}
                marks[:] = 0
                marks[list(leaving)] = list(leaving)
                back, reach, level, home = offers.table[:, : offers.end]
                gain = np.maximum.accumulate(marks)[reach] - back  # the longest that may come, less what goes for it
                gain[(level < f) | (home == a)] = 0
                best = int(gain.argmax())
                more = int(gain[best])
                if more <= 0:
                    break
                steps, b, there, here = True, int(home[best]), leaving[more + int(back[best])], offers.items[best]
                bins[a] = [i for i in own if i not in there] + list(here)
                bins[b] = [i for i in bins[b] if i not in here] + list(there)
                f -= more
                fill[a], fill[b] = f, fill[b] + more
                offers.renew(a)
                offers.renew(b)
                if fill[b] < capacity:
                    heapq.heappush(queue, (fill[b], b))
                left -= not f
    return full + [b for b in bins if b]


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row_number = opened(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for row, texts in text_chunks(batch.column(1)):
                flat, at = tokens.encode(texts)
                which, number, start, length, sums = [], [], [], [], []
                for i in range(len(texts)):
                    own = np.append(flat[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, a in enumerate(range(0, len(own), capacity)):
                        part = own[a : a + capacity]
                        which.append(row + i)
                        number.append(k)
                        start.append(a)
                        length.append(len(part))
                        sums.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(which)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64()), pa.array(np.arange(row_number, row_number + len(which)))],
                    names=["id", "piece", "start", "length", "ids_crc32", "number"],
                )
                row_number += len(which)

    return run


def _pack(capacity: int, level: int):
    """Every piece has its place; ``full`` says whether its bin has too little room to go on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "number"], ascending=[False, True]).reset_index(drop=True)
        lengths = pdf["length"].tolist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset, full = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        base = (level << 56) | (int(pdf["grp"].iloc[0]) << 20)
        for b, items in enumerate(bins):
            sizes = [lengths[i] for i in items]
            sequence[items] = base + b
            offset[items] = np.cumsum(sizes) - sizes
            full[items] = capacity - sum(sizes) < capacity / SLACK
        pdf["sequence_id"], pdf["offset"], pdf["full"] = sequence, offset, full
        return pdf.drop(columns="grp")

    return run


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each row of ``docs``: id, piece (from 0), start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its whole text by the tokenizers file ``tokenizer``, without special tokens, then
    ``end_id``. Only documents of more than ``capacity`` ids are cut, into pieces of that many and a rest. Pieces of a
    sequence follow each other without a gap. Null and empty texts are one piece of the end id. Repeated rows, and
    rows of one id, are documents of their own; ids may be null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, number bigint"
    left = cut(docs.select(id_col, text_col).mapInArrow(_pieces(tokenizer, end_id, capacity), columns), "pieces")
    done, level, count = None, 0, left.count()
    while True:
        groups = max(1, -(-count // GROUP))
        level += 1
        # dealt by the number of a written row, so neither an id nor a text, however often it stands, fills a group
        dealt = left.withColumn("grp", F.pmod(F.xxhash64("number", F.lit(level)), F.lit(groups)))
        packed = cut(dealt.groupBy("grp").applyInPandas(_pack(capacity, level), f"{columns}, sequence_id bigint, offset bigint, full boolean"), "packed")
        forget(left)
        open_ = packed.where("not full").count()
        last = groups == 1 or open_ > (1 - PROGRESS) * count
        placed = packed if last else packed.where("full")
        done = placed if done is None else done.unionByName(placed)
        if last or not open_:
            break
        left, count = cut(packed.where("not full").drop("sequence_id", "offset", "full"), "left"), open_
    return done.drop("number", "full").withColumnRenamed("id", id_col)
