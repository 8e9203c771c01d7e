"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece exactly one last token is valid: the one that starts where a shorter prefix ends, and that
stays apart from that prefix's own last token when the two are merged by rank. Storing it for every prefix gives the
piece's ids by walking back, lets bytes be appended exactly, and makes an edit cost only what lies near it, since a
prefix's token depends on the tokens of the prefixes at most one longest token before it.

Many pieces are read side by side as arrays, a byte of each at a time: an automaton over all tokens says which of them
end there, the longest first, and the seams are judged by tables, so nothing runs for a single byte in Python.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CHUNK, prepare
from .tokens import Numbers, text_chunks

#: Pieces and pairs of tokens that a worker keeps; beyond it forgets all of them.
KEPT, KEPT_BYTES = 400_000, 64 << 20
#: Pieces that are worth reading side by side; fewer are read one by one.
LANES = 64
_open: dict[tuple[str, str], Encoder] = {}


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Merges:
    """The ranks of a vocabulary, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Longest token that ends with these two bytes (or is one byte).
        self.reach: dict[bytes, int] = {}
        for b in ranks:
            self.reach[b[-2:]] = max(len(b), self.reach.get(b[-2:], 1))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte, or where merging never makes it."""
        if token not in self._halves:
            parts, ranks = [bytes([c]) for c in self.bytes[token]], self.ranks
            while len(parts) > 2:
                best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)))
                if best[0] == 1 << 62:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            self._halves[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.bytes[token]) == 1 or self.halves(token) is not None

    def apart(self, left: int, right: int) -> bool:
        """Do the two stay two tokens when their bytes are merged together?

        Merges are undone from the latest: at each step the two tokens at the seam stood side by side until the one
        of higher rank was made (of equal ranks, the left is made first), so a merge over the seam of a lower rank
        would have come before it.
        """
        key = left << 32 | right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 4 * KEPT:
                self._apart.clear()
            known = self._apart[key] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        ranks, text = self.ranks, self.bytes
        before = 1 << 62
        while True:
            if ranks.get(text[left] + text[right], 1 << 62) < before:
                return False
            a = self.halves(left) if len(text[left]) > 1 else None
            b = self.halves(right) if len(text[right]) > 1 else None
            if a and (not b or left > right):
                before, left = left, a[1]
            elif b:
                before, right = right + 1, b[0]
            else:
                return True

    def extend(self, data: bytes, begin: int, last: list[int]) -> list[int]:
        """``last`` tokens of the prefixes of fewer than ``begin`` bytes, and after them those of the longer ones."""
        get, reach, known, apart, last = self.ranks.get, self.reach.get, self._apart, self.apart, list(last)
        for end in range(max(1, begin), len(data) + 1):
            for start in range(max(0, end - reach(data[max(0, end - 2) : end], 1)), end):
                token = get(data[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start - 1]
                    stay = known.get(before << 32 | token)
                    if not (apart(before, token) if stay is None else stay):
                        continue
                if self.reachable(token):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is missing in the ranks")
        return last

    def encode(self, data: bytes) -> list[int]:
        last, out, at, text = self.extend(data, 1, []), [], len(data), self.bytes
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(text[token])
        return out[::-1]


class _Table:
    """Numbers from 0 for pairs of numbers under 2^31; -1 where there is none."""

    def __init__(self, most: int) -> None:
        self.numbers = Numbers(most)

    def _keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # an odd factor keeps different pairs different; 0 is a free place
        return ((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def add(self, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> None:
        self.numbers.add(self._keys(a, b), values)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.numbers.find(self._keys(a, b))


class Lanes:
    """``Merges`` for many pieces at once.

    A state of the automaton (Aho and Corasick) is the longest end of what was read that begins a token. ``longest`` is
    the longest token that ends there, ``shorter`` of a token the next one that ends with it; -1: none.
    """

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        tokens = sorted(merges.bytes)
        at = np.concatenate([[0], np.cumsum([len(merges.bytes[t]) for t in tokens])])
        data = np.frombuffer(b"".join(merges.bytes[t] for t in tokens), np.uint8)
        token, length = np.array(tokens), np.diff(at)
        top = tokens[-1] + 1
        self.length = np.ones(top, np.int64)
        self.length[token] = length
        self.next = _Table(len({b[:i] for b in merges.ranks for i in range(1, len(b) + 1)}))
        state, depth, fail, longest, count = np.zeros(len(token), np.int64), 0, [np.zeros(1, np.int64)], [np.full(1, -1)], 1
        self.fail, self.longest = fail[0], longest[0]
        self.shorter = np.full(top, -1)
        while len(on := np.flatnonzero(length > depth)):
            byte = data[at[on] + depth].astype(np.int64)
            keys, which = np.unique(state[on] << 8 | byte, return_inverse=True)
            parent, byte = keys >> 8, keys & 255
            back = self.step(self.fail[parent], byte) if depth else np.zeros(len(keys), np.int64)
            self.next.add(parent, byte, np.arange(count, count + len(keys)))
            state[on] = count + which
            most = self.longest[back]
            whole = length[on] == depth + 1
            self.shorter[token[on[whole]]] = most[which[whole]]
            most[which[whole]] = token[on[whole]]
            self.fail, self.longest = np.concatenate([self.fail, back]), np.concatenate([self.longest, most])
            count, depth = count + len(keys), depth + 1
        #: Of each token the two that make it; -1: none, -2: not worked out yet.
        self.left, self.right = (np.where(self.length > 1, -2, -1) for _ in range(2))
        #: The token that two make side by side.
        found = [(merges.ranks[b[:i]], merges.ranks[b[i:]], t) for t, b in merges.bytes.items() for i in range(1, len(b)) if b[:i] in merges.ranks and b[i:] in merges.ranks]
        a, b, c = np.array(found, np.int64).reshape(-1, 3).T
        self.both = _Table(len(found))
        self.both.add(a, b, c)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte of each."""
        out, state = self.next.find(state, byte), state.copy()
        open_ = np.flatnonzero((out < 0) & (state > 0))
        while len(open_):
            state[open_] = self.fail[state[open_]]
            out[open_] = self.next.find(state[open_], byte[open_])
            open_ = open_[(out[open_] < 0) & (state[open_] > 0)]
        return np.maximum(out, 0)

    def _learn(self, tokens: np.ndarray) -> None:
        """Work out the halves of these tokens, and of the halves."""
        todo = np.unique(tokens[self.left[tokens] == -2]).tolist()
        while todo:
            t = todo.pop()
            self.left[t], self.right[t] = self.merges.halves(t) or (-1, -1)
            todo += [x for x in (int(self.left[t]), int(self.right[t])) if x >= 0 and self.left[x] == -2]

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Merges.apart`` of many pairs."""
        out, on = np.ones(len(left), bool), np.arange(len(left))
        before = np.full(len(left), 1 << 62)
        while len(on):
            made = self.both.find(left, right)
            joins = (made >= 0) & (made < before)
            out[on[joins]] = False
            a, b = self.left[left] >= 0, self.left[right] >= 0
            a &= ~b | (left > right)
            keep = np.flatnonzero(~joins & (a | b))
            on, left, right, a = on[keep], left[keep], right[keep], a[keep]
            before = np.where(a, left, right + 1)
            left, right = np.where(a, self.right[left], left), np.where(a, right, self.left[right])
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Of each piece, its ids as little-endian unsigned 32-bit integers."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in order], np.int64)
        ends, falling = np.cumsum(sizes), -sizes
        at = ends - sizes
        data = np.frombuffer(b"".join(pieces[i] for i in order), np.uint8)
        last, state = np.zeros(len(data), np.int32), np.zeros(len(order), np.int64)
        # pieces are in order of falling length, so those that have another byte come first
        done = int(sizes[LANES - 1]) if len(sizes) >= LANES else 0
        for end in range(1, done + 1):
            n = int(np.searchsorted(falling, -end, "right"))
            state = self.step(state[:n], data[at[:n] + end - 1])
            lane, token = np.arange(n), self.longest[state]
            while len(lane):
                if (token < 0).any():
                    raise ValueError("a byte is missing in the ranks")
                if (self.left[token] == -2).any():
                    self._learn(token)
                begin = end - self.length[token]
                good = (self.length[token] == 1) | (self.left[token] >= 0)
                inner = np.flatnonzero(good & (begin > 0))
                good[inner] = self.apart(last[at[lane[inner]] + begin[inner] - 1], token[inner])
                last[at[lane[good]] + end - 1] = token[good]
                lane, token = lane[~good], self.shorter[token[~good]]
        for k in np.flatnonzero(sizes > done).tolist():  # the few longest
            last[at[k] : ends[k]] = self.merges.extend(pieces[order[k]], done + 1, last[at[k] : at[k] + done].tolist())
        ids, write, read = np.zeros(len(data), "<u4"), ends.copy(), ends.copy()
        lane = np.flatnonzero(sizes)
        while len(lane):
            if len(lane) < LANES:
                for k in lane.tolist():
                    w, r = int(write[k]), int(read[k])
                    while r > at[k]:
                        w -= 1
                        ids[w] = last[r - 1]
                        r -= int(self.length[ids[w]])
                    write[k] = w
                break
            token = last[read[lane] - 1]
            write[lane] -= 1
            ids[write[lane]] = token
            read[lane] -= self.length[token]
            lane = lane[read[lane] > at[lane]]
        raw, out = ids.tobytes(), [b""] * len(pieces)
        for i, a, b in zip(order, (4 * write).tolist(), (4 * ends).tolist(), strict=True):
            out[i] = raw[a:b]
        return out


class Prefixes:
    """A piece of bytes with the last token of each of its prefixes."""

    def __init__(self, merges: Merges, data: bytes = b"") -> None:
        self.merges, self.data, self.last = merges, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        begin = len(self.data)
        self.data += data
        self.last = self.merges.extend(self.data, begin + 1, self.last)

    def replace(self, begin: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of bytes [begin, end). Returns how many prefixes were worked out anew."""
        old, shift, reach = self.last, len(data) - (end - begin), self.merges.longest
        self.data = self.data[:begin] + data + self.data[end:]
        done = begin
        last = old[:begin]
        while done < len(self.data):
            # as many bytes more; once those after the edit are as they were for a longest token, the rest is too
            more = min(len(self.data), max(done, begin + len(data)) + reach)
            last = self.merges.extend(self.data[:more], done + 1, last)
            done = more
            if last[done - reach :] == old[done - reach - shift : done - shift] and done - reach >= begin + len(data):
                break
        self.last = last + old[done - shift :] if done < len(self.data) else last
        return done - begin

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.merges.bytes[out[-1]])
        return out[::-1]


class Encoder:
    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.merges = Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
        self.lanes: Lanes | None = None
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}
        self.held = 0
        self.table = [self.merges.bytes.get(i, b"") for i in range(max(self.merges.bytes) + 1)]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece: a piece that is a token is that token, as in the library."""
        whole = self.merges.ranks.get(data)
        return self.merges.encode(data) if whole is None else [whole]

    def pieces(self, data: list[bytes]) -> list[bytes]:
        """Ids of many pieces, as little-endian unsigned 32-bit integers."""
        if len(data) < LANES:
            return [np.array(self.piece(p), "<u4").tobytes() for p in data]
        self.lanes = self.lanes or Lanes(self.merges)
        get, out, held, size = self.merges.ranks.get, [b""] * len(data), [], 0
        for i, p in enumerate(data):
            whole = get(p)
            if whole is None:
                held.append(i)
                size += len(p)
            else:
                out[i] = whole.to_bytes(4, "little")
            if held and (size > CHUNK or i == len(data) - 1):  # a long text may bring very many
                for k, ids in zip(held, self.lanes.encode([data[k] for k in held]), strict=True):
                    out[k] = ids
                held, size = [], 0
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, all ids as little-endian unsigned 32-bit integers."""
        if len(self.kept) > KEPT or self.held > KEPT_BYTES:
            self.kept.clear()
            self.held = 0
        parts = [self.split(t) for t in texts]
        new = list(set().union(*parts).difference(self.kept))
        for p, ids in zip(new, self.pieces([p.encode() for p in new]), strict=True):
            self.kept[p] = ids
            self.held += 4 * len(p) + len(ids)
        return [b"".join(map(self.kept.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def opened(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _open:
        _open[path, pattern] = Encoder(path, pattern)
    return _open[path, pattern]


def _run(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(path, pattern)
        for batch in batches:
            for row, texts in text_chunks(batch.column(1)):
                coded = encoder.encode(texts)
                columns = [
                    batch.column(0).slice(row, len(texts)),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                    pa.array([hashlib.sha256(encoder.decode(c)).hexdigest() for c in coded]),
                ]
                if keep_ids:
                    at = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(coded), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return run


def bpe_round_trip(docs: DataFrame, *, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (array<int>).

    Each match of ``pattern`` in the whole text is encoded alone by the ranks in the file ``ranks``; null texts are
    empty and have no ids. Repeated rows fare alike; ids may be null; other columns are ignored. Ranks that lack a byte
    raise ValueError for a text that holds it.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(_run(ranks, pattern, keep_ids), schema)
