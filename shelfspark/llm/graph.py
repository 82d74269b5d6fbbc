"""Connected components on Spark by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import written
from shelfspark.session import Scratch


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``edges(a, b)``, the component being its smallest node.

    A node that is its own component is left out. Each step sends a node's
    neighbours to its smallest one; the joins are on the node, with one row per
    node on the other side, so a node with many neighbours can be split. Steps
    are written to the shared folder and the earlier ones deleted.
    """
    scratch = Scratch(edges.sparkSession)
    try:
        first = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
        name = scratch.keep(first)
        seen = None
        while True:
            e = edges.sparkSession.table(name)
            now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == seen:
                return written(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "components")
            both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
            after = scratch.keep(small)
            scratch.drop(name)
            name, seen = after, now
    finally:
        scratch.close()
