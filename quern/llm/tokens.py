"""Token ids of whole texts by the tokenizers library, with each spelling between blanks encoded once and kept.

That is exact for tokenizers that drop white space and never join across it, which ``WordTokens`` checks on the
tokenizer's own description before it relies on it. Spellings are known by a 64-bit hash of their bytes, so that a
text costs a few array operations and no Python object for each word; only spellings that a worker meets for the
first time are made strings and go to the library. (That two of the half a million it keeps share a hash has a chance
of about one in a hundred million.)
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from .common import ranges, span_hashes, word_spans

#: Spellings that a worker keeps; beyond it forgets all, so its memory is bounded.
KEPT, KEPT_IDS = 500_000, 8_000_000
#: Stands between pieces that are encoded together; a piece that holds it is encoded alone.
MARK = "\x01"
_open: dict[str, WordTokens] = {}
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def opened(path: str) -> WordTokens:
    if path not in _open:
        _open[path] = WordTokens(path)
    return _open[path]


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Numbers:
    """Numbers of 64-bit keys: a table of open addresses, looked up and filled for many keys at once."""

    def __init__(self, most: int) -> None:
        self.bits = (4 * most).bit_length()
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.count = 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray | None = None) -> None:
        """Give new keys, all different, these numbers, or the next."""
        if numbers is None:
            numbers = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.count += len(keys)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = keys[left[free]]
            done = self.keys[at[left]] == keys[left]
            self.values[at[left[done]]] = numbers[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)


class WordTokens:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(self.tokenizer.to_str())
        pre = said["pre_tokenizer"] or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        pattern, added = str(first.get("pattern")), said["added_tokens"]
        self.added = [t["content"][:2] for t in added]
        self.by_word = first.get("type") == "Split" and r"\s" in pattern and first["behavior"] == "Removed" and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in added)
        # a last comma or stop after a letter is a piece of its own
        self.splits_marks = self.by_word and r"[\\p{L}]+" in pattern and r"[^\\s\\p{L}\\p{N}]+" in pattern
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # words of letters, in lower case and composed, pass normalisation and the pattern as they are
        steps = {n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])}
        self.light = None
        if self.splits_marks and "Lowercase" in steps and steps <= {"NFC", "Replace", "Lowercase"}:
            said["normalizer"] = None
            said["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *pre["pretokenizers"][1:]]}
            self.light = Tokenizer.from_str(json.dumps(said))
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers(KEPT)
        self.flat, self.at = np.empty(1 << 16, np.uint32), np.zeros(1, np.int64)

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, one after another, how many each has). Many short texts cost less as a few long ones."""
        sizes = np.zeros(len(pieces), np.int64)
        rest = list(range(len(pieces)))
        if self.light is not None:
            plain = [i for i in rest if pieces[i].isalpha() and pieces[i] == pieces[i].lower() and (pieces[i].isascii() or unicodedata.is_normalized("NFC", pieces[i]))]
            runs = [plain[i : i + 256] for i in range(0, len(plain), 256)]
            flat, many = [], []
            for e, run in zip(self.light.encode_batch([" ".join([pieces[i] for i in run]) for run in runs], add_special_tokens=False), runs, strict=True):
                flat.append(np.array(e.ids, np.uint32))
                many.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(run)))
            known = set(plain)
            rest = [i for i in rest if i not in known]
            order, ids = plain, flat
            sizes[plain] = np.concatenate(many) if many else 0
        else:
            order, ids = [], []
        marked = [i for i in rest if MARK not in pieces[i]] if self.mark is not None else []
        if marked:
            joint = f" {MARK} "
            encoded = self.tokenizer.encode_batch_fast([joint.join([pieces[i] for i in marked[k : k + 256]]) + f" {MARK}" for k in range(0, len(marked), 256)], add_special_tokens=False)
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
            ends = np.flatnonzero(flat == self.mark)
            if len(ends) == len(marked):
                sizes[marked] = np.diff(ends, prepend=-1) - 1
                order, ids = order + marked, [*ids, flat[flat != self.mark]]
                rest = [i for i in rest if MARK in pieces[i]]
        if rest:
            encoded = [e.ids for e in self.tokenizer.encode_batch([pieces[i] for i in rest], add_special_tokens=False)]
            sizes[rest] = [len(x) for x in encoded]
            order, ids = order + rest, [*ids, np.array([t for x in encoded for t in x], np.uint32)]
        if not order:
            return np.empty(0, np.uint32), sizes
        # from the order of encoding to that of the pieces
        place = np.empty(len(pieces), np.int64)
        place[order] = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
        return np.concatenate(ids)[ranges(place, sizes)], sizes

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        flat, sizes = self._ids_of(pieces)
        end = int(self.at[-1]) + len(flat)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.at[-1]], np.empty(end, np.uint32)])
        self.flat[self.at[-1] : end] = flat
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.numbers.add(keys)

    def _lowered(self, text: str) -> str:
        """In lower case, where that is what the tokenizer will do: spellings that differ in case are then one."""
        if self.light is None or not (text.isascii() or unicodedata.is_normalized("NFC", text) and "Σ" not in text and "İ" not in text) or any(a in text for a in self.added):
            return text
        return text.lower()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's begin, with the end after the last)."""
        if not self.by_word:
            encoded = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter((i for x in encoded for i in x), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in encoded], dtype=np.int64)])
        if self.numbers.count > KEPT or int(self.at[-1]) > KEPT_IDS:
            self.forget()
        raw = [self._lowered(t).encode() for t in texts]
        joint = b"".join(raw)
        data = np.frombuffer(joint, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
        starts, ends = word_spans(data, offsets)
        if self.splits_marks and len(starts):
            last = data[ends - 1]
            own = np.flatnonzero(((last == 44) | (last == 46)) & (ends - starts > 1) & _LETTER[data[ends - 2]])
            where = np.arange(len(starts)) + np.searchsorted(own, np.arange(len(starts)), "left")
            marks = where[own] + 1
            cut = ends.copy()
            cut[own] -= 1
            both = np.empty((2, len(starts) + len(own)), np.int64)
            both[:, where], both[:, marks] = (starts, cut), (cut[own], ends[own])
            starts, ends = both
        keys = span_hashes(data, starts, ends) | np.uint64(1)
        number = self.numbers.find(keys)
        if (number < 0).any():
            fresh = np.flatnonzero(number < 0)
            new, sample = np.unique(keys[fresh], return_index=True)
            sample = fresh[sample]
            self._learn(new, [joint[a:b].decode() for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)])
            number[fresh] = self.numbers.find(keys[fresh])
        sizes = self.at[number + 1] - self.at[number]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[ranges(self.at[number], sizes)], before[np.searchsorted(starts, offsets)]


def text_chunks(texts: pa.Array, most_chars: int = 1 << 20):
    """(first row, texts) of runs of a column's texts of about so many characters; null: empty."""
    run, at, size = [], 0, 0
    for i, t in enumerate(texts.to_pylist()):
        run.append(t or "")
        size += len(run[-1])
        if size >= most_chars:
            yield at, run
            run, at, size = [], i + 1, 0
    if run:
        yield at, run
