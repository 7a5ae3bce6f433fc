"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudscope.llm.common import join_hot, materialise


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges (a long, b long)``; the root is the component's smallest node.

    Large star: every node sends its larger neighbours to the smallest of its
    neighbourhood; small star: its smaller ones and itself. After O(log n)
    rounds each component is one star. A round's edges are written, so that the
    plan does not grow and lost executors cost one round. The edges of a hub
    meet its smallest neighbour where they are (``join_hot``), not in one task.
    """
    a, b = F.col("a"), F.col("b")
    now = materialise(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), name)
    n_edges, mark = now.count(), None
    while True:
        both = now.select(a.alias("v"), b.alias("u")).unionByName(now.select(b.alias("v"), a.alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both.filter("u > v"), low, "v", n_edges).select(F.col("u").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # each row has a > b, so a node's smaller neighbours are its rows; there are n_edges rows at most
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, least, "a", n_edges).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = materialise(small.filter("a <> b").distinct(), name)
        # three sums identify the edge set well enough to see that it has stopped changing
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.sum(F.xxhash64("b", "a") % 1000003)).first())
        if seen == mark:
            break
        n_edges, mark = seen[0], seen
    roots = now.select(b.alias("node"), b.alias("root")).distinct()
    return now.select(a.alias("node"), b.alias("root")).unionByName(roots)
