"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``); the root is the smallest node.

    Each round makes every node point at the smallest node it knows of and
    rewires its neighbours to it, so a chain shrinks by a constant factor and a
    hub never gathers its neighbours in one task: only their minimum is
    aggregated, on the map side first. Every round is written to the shared
    folder. Rows with a NULL end are not edges. No edges give no rows; a graph
    that is not settled after ``most_rounds`` raises.
    """
    a, b = F.col("a"), F.col("b")
    links = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links = materialize(links, "links")

    def stars(current: DataFrame, both: bool) -> DataFrame:
        """Link the neighbours of a node to the smallest of them and the node itself."""
        near = current
        if both:
            near = near.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = near.join(least, "a")
        if both:
            # Large star: only neighbours larger than the node move.
            return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the node and its smaller neighbours move.
        moved = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b")))

    seen = None
    for _ in range(most_rounds):
        large = stars(links, both=True)
        small = stars(large.filter("a != b").distinct(), both=False)
        links = materialize(small.filter("a != b").distinct(), "links")
        mark = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == seen or not mark[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
