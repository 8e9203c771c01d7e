"""Model calls as Column functions, with stand-ins that need no service and give the same result in every run."""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_vector(text: str, dimension: int) -> list[float]:
    """A unit vector from the words of a text: equal texts are equal, shared words bring texts nearer."""
    out = np.zeros(dimension)
    for word in re.findall(r"[一-鿿]|\w+", (text or "").lower()):
        code = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        out[code % dimension] += 1 if code >> 63 else -1
    length = np.linalg.norm(out)
    return (out / length if length else out).astype(np.float32).tolist()


def hashing_embedder(dimension: int = 256) -> Callable[[list[str]], list[list[float]]]:
    return lambda texts: [hash_vector(t, dimension) for t in texts]


def embed(embedder: Callable[[list[str]], list[list[float]]], batch_size: int = 16) -> Callable[[Column], Column]:
    """A column function that calls ``embedder`` on ``batch_size`` texts at a time, in order. A reply of another
    length than the request is an error, not a shift of vectors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            texts, out = series.fillna("").tolist(), []
            for i in range(0, len(texts), batch_size):
                part = texts[i : i + batch_size]
                vectors = embedder(part)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts were sent and {len(vectors)} vectors came back")
                out.extend(vectors)
            yield pd.Series(out, dtype=object)

    return run


def chat(model: Callable[[str, str], str], system: str) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: model(system, p))

    return run


def scorer(model: Callable[[str, list[str]], list[float | None]]) -> Callable[[Column, Column], Column]:
    """A rerank scorer from a model that scores several texts for one query. A failing call gives nulls, so that the
    query keeps its order."""

    @F.pandas_udf("double")
    def run(query: pd.Series, content: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(query), index=query.index, dtype="float64")
        for text, rows in query.groupby(query).groups.items():
            try:
                scores = model(text, content.loc[rows].tolist())
                if len(scores) == len(rows):
                    out.loc[rows] = scores
            except Exception as error:
                logging.getLogger(__name__).warning("no scores for %d texts: %s: %s", len(rows), type(error).__name__, error)
        return out

    return run


def formula_text(content: Column, ocr: Column) -> Column:
    """What a formula reader made of the crop, if anything, else the flat text."""
    return F.coalesce(F.nullif(F.trim(ocr), F.lit("")), content)
