"""A compressed full-text index over sequences of integers: suffix order, Burrows-Wheeler transform, wavelet trees.

The transform is compressed to about its entropy by alphabet partitioning: symbols are numbered by falling frequency, and
those whose numbers have j + 1 bits are a class. One wavelet matrix holds the class of each place, and another for each
class the j lower bits of its own places, so a frequent symbol takes few bits. The matrices of all classes lie side by
side, level by level, and a lane (a pattern that is being read) leaves after the levels of its class.

All steps take many patterns at once, as arrays; nothing runs per symbol in Python.
"""

from __future__ import annotations

import numpy as np


def suffix_ranks(keys: np.ndarray) -> np.ndarray:
    """Place of each suffix in sorted order, by prefix doubling on those still tied. The last key must be unique."""
    n = len(keys)
    active = np.argsort(keys)
    rank, base, key = np.zeros(n, np.int64), np.zeros(n, np.int64), keys[active]
    k = 0
    while len(active):
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.ones(len(active), bool)
        group[1:] = base[1:] != base[:-1]
        i = np.arange(len(active))
        within = i - np.maximum.accumulate(np.where(group, i, 0))
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(active)))
        rank[active] = np.repeat(base[first] + within[first], sizes)
        tied = np.repeat(sizes > 1, sizes)
        active = active[tied]
        k = max(1, 2 * k)
        if len(active):
            key = rank[active] * n + rank[active + k // 2 if k > 1 else active + 1]
        order = np.argsort(key[: len(active)] if len(active) else np.empty(0))
        active, key = active[order], key[: len(active)][order]
        base = rank[active]
    return rank


#: The bits below each bit of a word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with the number of ones before any place, in 64-bit words and a 32-bit count for each."""

    def __init__(self, ones: np.ndarray) -> None:
        self.words = np.zeros(len(ones) // 64 + 1, np.uint64)
        packed = np.packbits(ones, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.counts[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.counts.take(word) + np.bitwise_count(self.words.take(word) & _BELOW.take(at & 63))


class FMIndex:
    """``text``: symbols from 1; each sequence ends with a 0. ``weights``: of each sequence.

    An interval [lo, hi) stands for the suffixes that begin with what was read so far, from right to left.
    """

    def __init__(self, text: np.ndarray, weights: np.ndarray) -> None:
        marks = text == 0
        count = int(marks.sum())
        keys = np.where(marks, np.cumsum(marks) - 1, text.astype(np.int64) + count)
        rank = suffix_ranks(keys)
        order = np.empty(len(text), np.int64)
        order[rank] = np.arange(len(text))
        sequence = np.cumsum(marks) - marks
        #: Sum of weights of the first i suffixes in order, in as few bytes as hold it.
        total = int(weights[sequence].sum())
        self.weight = np.zeros(len(text) + 1, np.uint32 if total < 1 << 32 else np.int64)
        np.cumsum(weights[sequence[order]], out=self.weight[1:])
        bwt = text[order - 1]
        del order, sequence, keys, rank
        self.size, symbols = len(text), int(text.max()) + 1
        often = np.bincount(text, minlength=symbols)
        self.before = np.concatenate([[0], np.cumsum(often)])[:symbols]
        number = np.empty(symbols, np.int64)
        number[np.argsort(-often, kind="stable")] = np.arange(1, symbols + 1)
        #: Of each symbol: its class, and its place in the class, which has the number's lower bits.
        self.kind = np.frexp(number.astype(float))[1].astype(np.int64) - 1
        self.rest = number - (np.int64(1) << self.kind)
        self.classes: list[tuple[int, Bits, int]] = []
        kinds = self.kind[bwt]
        held = kinds
        for bit in range(max(1, int(self.kind.max()).bit_length()) - 1, -1, -1):
            ones = (held >> bit & 1).astype(bool)
            self.classes.append((bit, Bits(ones), len(ones) - int(ones.sum())))
            held = np.concatenate([held[~ones], held[ones]])
        #: Places of each class: the classes lie side by side in every level.
        sizes = np.bincount(kinds, minlength=int(self.kind.max()) + 1)
        parts = {j: self.rest[bwt[kinds == j]] for j in range(1, len(sizes))}
        del held, kinds, bwt
        #: Level d: its bits, and what is added to a place on its way to the next level, by twice its class and its bit.
        self.levels: list[tuple[Bits, np.ndarray]] = []
        base, shifts = np.zeros((len(sizes), len(sizes)), np.int64), []
        for d in range(len(sizes) - 1):
            before, zeros = (np.zeros(len(sizes), np.int64) for _ in range(2))
            level, at, total = [], 0, 0
            for j in range(d + 1, len(sizes)):
                ones = (parts[j] >> (j - 1 - d) & 1).astype(bool)
                base[d, j], before[j], zeros[j] = at, total, len(ones) - int(ones.sum())
                at, total = at + len(ones), total + int(ones.sum())
                level.append(ones)
                parts[j] = np.concatenate([parts[j][~ones], parts[j][ones]])
            self.levels.append((Bits(np.concatenate(level)), np.empty(0, np.int64)))
            shifts.append((before, zeros))
        for d, (before, zeros) in enumerate(shifts):
            after = base[d + 1]  # of a class that has no more levels: 0
            self.levels[d] = (self.levels[d][0], np.stack([before - base[d] + after, zeros - before + after], 1).ravel())
        #: From the last order of classes to the first level, of each class: where its run begins, and where its places do.
        self.enter = np.zeros(len(sizes), np.int64)
        self.enter = base[0] - self._class_at(np.arange(len(sizes)), np.zeros((1, len(sizes)), np.int64))[0]
        #: Classes with a falling sign: few values, which sort fast.
        self.falling = (-self.kind).astype(np.int8)
        #: From the last order of a symbol's class to the order of suffixes.
        self.leave = np.zeros(symbols, np.int64)
        self.leave = self.before - self._descend(np.arange(symbols), np.zeros((1, symbols), np.int64))[0]
        #: The suffixes that begin with a symbol end before this one.
        self.after = self.before + often

    def _class_at(self, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.classes:
            ones = bits.rank(at)
            at = np.where(kind >> bit & 1, ones + zeros, at - ones)
        return at + self.enter.take(kind)

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each row of places before each symbol: the order of the suffixes that begin with the symbol."""
        falling = self.falling.take(symbols)
        order = np.argsort(falling, kind="stable")  # lanes leave from the end, after the levels of their class
        lanes = np.searchsorted(falling[order], np.arange(0, -len(self.levels), -1)).tolist()
        symbols = symbols[order]
        kind, rest = self.kind.take(symbols), self.rest.take(symbols)
        at = self._class_at(kind, at[:, order])
        for d, ((bits, shift), n) in enumerate(zip(self.levels, lanes, strict=True)):
            if not n:
                break
            now, bit = at[:, :n], rest[:n] >> (kind[:n] - (1 + d)) & 1
            ones = bits.rank(now)
            at[:, :n] = np.where(bit, ones, now - ones) + shift.take(2 * kind[:n] + bit)
        out = np.empty_like(at)
        out[:, order] = at + self.leave.take(symbols)
        return out

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after reading one more symbol to the left of each."""
        at = self._descend(symbols, np.stack([lo, hi]))
        return at[0], at[1]


def repeated_windows(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, core: np.ndarray, window: int) -> np.ndarray:
    """Flags over ``text`` of the windows that begin there and occur with a total weight of 2 or more.

    Sequence i is text[begin[i]:end[i]], and its windows all hold the symbol before core[i], an end within it.
    For an end e, left(e) is where the longest repeated string that ends at e begins (the matching statistic). It never
    falls as e grows, so an end that was read bounds all others: of the ends from ``bottom`` to before ``top``, left is
    ``least`` or later, and no later than it was at top. The last end is read first, then the core, and then the middle of
    what is open, which leaves two parts, each without the windows that the match has settled.
    """
    found = np.zeros(len(text) + 1, np.int64)
    lane = np.flatnonzero(end - begin >= window)
    least, stop = begin[lane], end[lane]
    bottom, top = np.maximum(core[lane], least + window), stop + 1
    turn = np.zeros(len(lane), np.int64)  # 0: the last end is read, 1: the core, 2: any other end
    pointer, lo, hi = _begin(index, text, stop)
    while len(lane):
        new_lo, new_hi = index.extend(text[np.maximum(pointer - 1, 0)], lo, hi)
        grows = (index.weight[new_hi] - index.weight[new_lo] >= 2) & (pointer > least)
        lo, hi, pointer = np.where(grows, new_lo, lo), np.where(grows, new_hi, hi), pointer - grows
        ended = ~grows | (pointer == least)
        rest = np.flatnonzero(ended)
        if not len(rest):
            continue
        left, e = pointer[rest], stop[rest]
        long = e - left >= window
        np.add.at(found, left[long], 1)
        np.add.at(found, e[long] - window + 1, -1)
        i, now, under, low, high = lane[rest], turn[rest], bottom[rest], least[rest], top[rest]
        # what is open above the end that was read, and below it; the core is under all others
        above = now > 0
        parts = [
            (i[above], np.full(int(above.sum()), 2), np.maximum(e + 1, left + window)[above], high[above], left[above]),
            (i[now != 1], np.minimum(now + 1, 2)[now != 1], under[now != 1], np.minimum(e, left + window)[now != 1], low[now != 1]),
        ]
        i, now, under, high, low = (np.concatenate(x) for x in zip(*parts, strict=True))
        open_ = under < high
        i, now, under, high, low = (x[open_] for x in (i, now, under, high, low))
        e = np.where(now == 1, core[i], (under + high) // 2)
        begun, first, last = _begin(index, text, e)
        keep = ~ended
        lane, turn, bottom, top, least, stop, pointer, lo, hi = (
            np.concatenate([x[keep], y]) for x, y in ((lane, i), (turn, now), (bottom, under), (top, high), (least, low), (stop, e), (pointer, begun), (lo, first), (hi, last))
        )
    return np.cumsum(found)[: len(text)] > 0


def _begin(index: FMIndex, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pointer, interval) after the symbol before each stop; where that stands once, the stop and nothing."""
    symbol = text[stop - 1]
    lo, hi = index.before[symbol], index.after[symbol]
    more = index.weight[hi] - index.weight[lo] >= 2
    return stop - more, np.where(more, lo, 0), np.where(more, hi, 0)
