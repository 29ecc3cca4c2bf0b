"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import stored


def contract(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) for every node: the least node reachable over links (a, b).

    Each round lets a node follow its least neighbour, shortens those paths
    to their roots by doubling, renames the links to roots and drops those
    that became loops. Roots at least halve in number each round; links and
    labels stay tables throughout. Every round's tables are written, so the
    plan does not grow and a lost executor repeats one round at most.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    named = None  # (node, label) of the nodes that any link reaches
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up"))
        up = stored(step, "up")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            far = stored(up.join(over, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "up")
            up = far.select("node", "up")
            if far.filter("moved").isEmpty():
                break
        left = up.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = stored(edges.join(left, "a").join(right, "b")
                       .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct(), "edges")
        if named is None:
            named = up.withColumnRenamed("up", "label")
        else:
            named = stored(named.join(up.withColumnRenamed("node", "label"), "label", "left")
                           .select("node", F.coalesce("up", "label").alias("label")), "labels")
    if named is None:
        return nodes.select("node", F.col("node").alias("label"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
