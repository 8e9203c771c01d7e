"""Words of texts without blanks between them, by a dictionary: the likeliest path, and shorter words within long ones.

A dictionary maps words to counts. It is the caller's (a file of lines ``word count``); none comes with the package.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import functions as F

from .text import Segment

_RUN = re.compile("[一-鿿]+|[^\\s一-鿿]+")
#: What stands at the ends of a Latin word without being part of it.
_ENDS = ".,;:!?()[]{}\"“”，。？！；、：（）"


class Dictionary:
    def __init__(self, counts: dict[str, int]) -> None:
        self.cost = {w: -math.log(max(n, 1)) for w, n in counts.items() if w}
        self.total = math.log(max(1, sum(max(n, 1) for n in counts.values())))
        self.longest = max(map(len, self.cost), default=1)

    @classmethod
    def read(cls, lines: Iterable[str]) -> Dictionary:
        """From lines ``word count ...``; a word without a count has 1."""
        found = {}
        for line in lines:
            if parts := line.split():
                found[parts[0]] = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else 1
        return cls(found)

    def path(self, run: str) -> list[str]:
        """The words of one run on the likeliest way through it; what the dictionary lacks goes by single characters."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            ways = []
            for begin in range(max(0, end - self.longest), end):
                cost = self.cost.get(run[begin:end])
                if cost is not None or end - begin == 1:
                    ways.append((best[begin][0] + self.total + (cost or 0.0), begin))
            best.append(min(ways))
        words, end = [], len(run)
        while end:
            words.append(run[best[end][1] : end])
            end = best[end][1]
        return words[::-1]

    def words(self, text: str) -> list[str]:
        """All words of a text in order. Before a word of three characters or more come the words of two, and of three,
        that stand within it, so a search for a part finds the whole."""
        out: list[str] = []
        for run in _RUN.findall(text or ""):
            if not "一" <= run[0] <= "鿿":
                out.append(run.strip(_ENDS))
                continue
            for word in self.path(run):
                for n in (2, 3):
                    if len(word) > n:
                        out += [part for i in range(len(word) - n + 1) if (part := word[i : i + n]) in self.cost]
                out.append(word)
        return out


def segmenter(dictionary: Dictionary) -> Segment:
    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(dictionary.words)

    return cut
