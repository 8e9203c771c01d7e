"""Connected components by alternating large and small stars, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), of any one type that orders; root is the least node reached.

    Each round points every node's neighbours at the least of them, which at least halves the depth, and is
    written to the shared folder. Nodes of a huge degree cost no more than their rows: the least neighbour is
    aggregated before the shuffle, and the join back can be split by adaptive execution. Null ends are left out;
    no edges give no rows.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        name,
    )

    def signature(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())

    state = signature(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large.where("a <> b"), name)
        forget(least)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), name)
        joined = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = cut(joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        forget(now, large, least)
        now = small
        seen = signature(now)
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
