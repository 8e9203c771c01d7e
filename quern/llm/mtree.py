"""Exact top-k by inner product with M-trees: paged metric nodes, covering radii, stored parent distances.

Inner products become distances by one more component: with R the greatest norm of a tree's vectors, x becomes
(x, sqrt(R^2 - |x|^2)) and a query q becomes (q, 0), so |q' - x'|^2 = |q|^2 + R^2 - 2 q.x, and the nearest have the
highest products. Rows are numbered as they are written and dealt by number into blocks; a task builds the tree of a
block once and searches it best first for all queries, which it reads batch by batch. Each query's best of each block then
meet. Blocks have a bounded number of rows, so memory is bounded, whatever the table holds: neither an id nor a vector,
however often it stands, fills a block.

Bounds only decide what is left out, with some slack for rounding; scores are exact integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

#: Entries of a page; candidates of a block, about.
PAGE, ROWS = 512, 24_000


class Node:
    """A page: either entries (a run of the tree's vectors) or child nodes. ``parent``: distances of the entries' or
    the children's centres from this node's centre; ``radius`` of each child covers all below it."""

    __slots__ = ("centre", "radius", "items", "children", "parent", "centres", "radii")

    def __init__(self, centre: np.ndarray) -> None:
        self.centre, self.radius, self.items, self.children = centre, 0.0, None, []


class MTree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, page: int = PAGE) -> None:
        """``vectors``: integers, one row each, in float64 where products are exact, else int64."""
        self.vectors, self.page = vectors, page
        norms = np.einsum("ij,ij->i", vectors, vectors).astype(float)
        self.reach = float(norms.max())
        self.points = np.column_stack([vectors.astype(float), np.sqrt(np.maximum(self.reach - norms, 0))])
        self.computed = self.filled = 0
        pages: list[np.ndarray] = []
        self.root = self._build(np.arange(len(vectors)), pages)
        order = np.concatenate(pages)  # the entries of a page lie side by side
        self.vectors, self.ids = vectors[order], ids[order]
        del self.points

    def _build(self, rows: np.ndarray, pages: list[np.ndarray]) -> Node:
        points = self.points[rows]
        centre = points[np.argmin(((points - points.mean(0)) ** 2).sum(1))]
        node = Node(centre)
        distance = np.sqrt(((points - centre) ** 2).sum(1))
        node.radius = float(distance.max())
        if len(rows) <= self.page or node.radius == 0:
            node.items, node.parent = (self.filled, self.filled + len(rows)), distance
            self.filled += len(rows)
            pages.append(rows)
            return node
        count = min(self.page, max(2, -(-len(rows) // self.page)))
        pivots = [int(np.argmax(distance))]
        squares = np.einsum("ij,ij->i", points, points)
        nearest = ((points - points[pivots[0]]) ** 2).sum(1)
        owner = np.zeros(len(rows), np.int64)
        while len(pivots) < count and nearest.max() > 0:  # each next pivot lies farthest from those before
            far = int(np.argmax(nearest))
            d = np.maximum(squares + squares[far] - 2 * (points @ points[far]), 0)  # for choosing only; radii are exact
            d[far] = 0
            owner[d < nearest] = len(pivots)
            nearest = np.minimum(nearest, d)
            pivots.append(far)
        node.children = [self._build(rows[owner == k], pages) for k in range(len(pivots))]
        node.centres = np.stack([c.centre for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        node.parent = np.sqrt(((node.centres - centre) ** 2).sum(1))
        return node

    def search(self, query: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of all rows but those with id ``own``; ties to the smaller id."""
        exact = query.astype(self.vectors.dtype)
        q = np.append(query.astype(float), 0.0)
        square = float(q @ q)
        slack = 1e-9 * (square + self.reach) + 1e-6
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
        limit = math.inf  # greatest distance that can still matter

        def to_distance(score: int) -> float:
            return math.sqrt(max(0.0, square + self.reach - 2 * score) + 2 * slack) + slack

        at = float(np.sqrt(((q - self.root.centre) ** 2).sum()))
        queue, number = [(max(0.0, at - self.root.radius), 0, at, self.root)], 1
        while queue:
            low, _, at, node = heapq.heappop(queue)
            if low > limit:
                break
            if node.items is None:
                near = np.flatnonzero(np.abs(at - node.parent) - node.radii <= limit)  # settled by stored distances alone
                if not len(near):
                    continue
                d = np.sqrt(((node.centres[near] - q) ** 2).sum(1))
                self.computed += len(near)
                lows = np.maximum(d - node.radii[near], 0)
                for j in np.flatnonzero(lows <= limit):
                    heapq.heappush(queue, (float(lows[j]), number, float(d[j]), node.children[near[j]]))
                    number += 1
                continue
            a, b = node.items
            near = np.arange(b - a) if limit == math.inf else np.flatnonzero(np.abs(at - node.parent) <= limit + slack)
            if not len(near):
                continue
            self.computed += len(near)
            if 2 * len(near) > b - a:  # a page as it lies is read faster than picked rows
                scores = (self.vectors[a:b] @ exact)[near]
            else:
                scores = self.vectors[a + near] @ exact
            ids = self.ids[a + near]
            if len(best) == k:
                good = np.flatnonzero(scores >= best[0][0])
                scores, ids = scores[good], ids[good]
            if own is not None:
                other = ids != own
                scores, ids = scores[other], ids[other]
            if len(ids) > k:
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                entry = (int(s), -i)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                limit = to_distance(best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of one length, as integers: float64 where all products are exact, else int64."""
    exact = np.asarray(column.flatten()).reshape(len(column), -1)
    most = int(np.abs(exact).max(initial=0))
    return exact.astype(np.float64) if most * most * exact.shape[1] < 1 << 52 else exact


def _search(k: int):
    """Sorted rows (block, length, asks, id, v): of each block and length the candidates come first, then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        held: list[tuple[pa.Array, pa.Array]] = []
        for batch in batches:
            place = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(3)], 1)
            turns = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(place)], strict=True):
                if a == b:
                    continue
                if (key := tuple(place[a, :2].tolist())) != at:
                    at, tree, held = key, None, []
                ids, vectors = batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a)
                if not place[a, 2]:
                    held.append((ids, vectors))
                    continue
                if tree is None and held:
                    tree = MTree(_matrix(pa.concat_arrays([v for _, v in held])), np.concatenate([np.asarray(i) for i, _ in held]))
                    held = []
                if tree is None:
                    continue
                out: list[tuple[int, int, int]] = []
                for own, q in zip(ids.to_pylist(), _matrix(vectors), strict=True):
                    if q.dtype != tree.vectors.dtype:
                        q, tree.vectors = q.astype(np.int64), tree.vectors.astype(np.int64)
                    out += [(own, i, score) for score, i in tree.search(q, own, k)]
                found = np.array(out, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, c].copy()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, rows_per_block: int = ROWS) -> DataFrame:
    """Each query's ``k`` highest inner products: query_id, rank (from 1), vec_id, score; ties to the smaller id.

    Components become floor(scale * x). Rows with a query's own id are no candidates of it; fewer candidates give fewer
    rows. Vectors that are null, empty, or hold a null or non-finite component, and rows without an id, take no part.
    Only vectors of one length are compared. Every row is a candidate, so a repeated row can be found as often as it
    stands. A repeated query row is asked once; an id with several vectors gets the best of what each of them finds.
    Ids are integers; other columns are ignored. Scores are 64-bit integers: vectors of components so large that a product
    could pass 2^63 - 1 raise OverflowError before anything is searched.
    """
    prepare(vectors.sparkSession)

    def clean(df: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        good = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0)
        finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
        v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
        most = F.array_max(F.transform(x, lambda c: F.abs(F.floor(c.cast("double") * F.lit(float(scale))).cast("double"))))
        return df.where(good & finite).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.size(x).alias("length"), (most * F.sqrt(F.size(x))).alias("most"))

    numbered = cut(clean(vectors).withColumn("number", F.monotonically_increasing_id()), "vectors")
    asked = clean(queries)
    count, most = numbered.agg(F.count("*"), F.max("most")).first()
    largest = (most or 0) * (asked.agg(F.max("most")).first()[0] or 0)  # of any product, by components of one sign
    if largest >= 2.0**63 * (1 - 1e-9):
        raise OverflowError(f"inner products could reach {largest:.3g}, beyond 64-bit integers")
    blocks = max(1, -(-count // rows_per_block))
    rows = numbered.select(F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int").alias("block"), "length", F.lit(False).alias("asks"), "id", "v")
    asked = asked.select("length", F.lit(True).alias("asks"), "id", "v").distinct()
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "length", "asks", "id", "v")
    dealt = rows.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "length", "asks")
    found = dealt.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
