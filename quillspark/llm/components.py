"""Connected components of a graph given by its links, without moving it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import drop_table, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of the links ``a, b``; the component is its
    smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): a node never
    gathers its neighbours in one list, each step is two aggregations and joins, and the
    number of steps grows with the logarithm of the graph.  Each step's links are written to
    the shared folder.  Links of a node to itself and NULL ends are ignored.
    """
    links = materialize(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or state[0] == 0:
            break
        seen = state
        # large star: every larger neighbour of a node is linked to the least of its neighbours and itself
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("u"), "v").distinct()
        # small star: the smaller neighbours of a node and itself are linked to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
        small = small.unionByName(low.select(F.col("m").alias("u"), "v")).where("u <> v").distinct()
        after = materialize(small, "cc")
        drop_table(links)
        links = after
    return links.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component").unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
