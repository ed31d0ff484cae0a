"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldjobs.llm.recovery import cut


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest node reachable from each linked node.

    ``links`` has columns ``a`` and ``b``; null ends and loops are ignored. Returns
    ``node, root`` for nodes with a link. Alternates large-star and small-star steps
    until the link table is a forest of stars; each step moves O(links) rows, joins on
    plain keys (so a hot hub is split by adaptive execution) and is written to the
    shared folder.
    """
    edges = cut(_pairs(links.where("a <> b")))
    before = None
    for _ in range(max_rounds):
        edges = _star(edges, small=False)
        edges = cut(_star(edges, small=True))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _pairs(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each neighbour of a node to the node's smallest neighbour or itself."""
    if small:
        around = edges
    else:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = around.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _pairs(moved)
