"""Connected components by alternating large-star and small-star steps.

Every step is a group-by for the smallest neighbour and a join back on the
node, both on keys; a node with very many neighbours is pre-aggregated and its
join is left to AQE's skew splitting.  The number of steps grows with the
logarithm of a component's diameter.  Each step is written to the shared
folder, so lost executors cost one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for ``edges`` (``a``, ``b``).

    Edges from a node to itself make it a component of its own; nulls are
    ignored.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b")
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "components-nodes")
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links = written(links, "components-links")
    seen = None
    while True:
        links = written(_small_star(_large_star(links)), "components-links")
        # a star per component: each node with its smallest one, no node both
        state = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return nodes.join(links.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component")
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = both.where("b > a").join(least.hint("merge"), "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    moved = links.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.union(moved).where("a > b").distinct()
