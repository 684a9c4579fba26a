"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgeframe.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half step: hang each node's neighbours on the smallest of them.

    ``large``: larger neighbours of a node move to the smallest of its closed
    neighbourhood; otherwise its smaller ones and the node itself do. Edges are
    (u, v) with v < u. The minimum per node is added up before the shuffle, and the
    join repeats only that one row per node, so a node with very many neighbours is
    split by Spark's own skew handling.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b): the smallest node reachable.

    Large-star and small-star steps alternate until nothing moves; that takes
    about the square of the logarithm of the nodes at most. Each round is cut by a
    checkpoint. Self-loops and repeated edges do no harm.
    """
    now = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    while True:
        now = cut(_star(_star(now, True), False))
        # Every round keeps one row a node in the end; count and sum of hashes show a fixed point.
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(seen)
