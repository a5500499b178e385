"""Connected components of links, as joins over stored edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fragx.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest node of its component.

    Alternating large and small stars: each turn links a node's neighbours to
    the smallest of them, so paths shrink by half or more. Minima combine on
    the map side; edges are stored each turn, so a node with very many links
    meets its minimum in a join whose sides adaptive execution can split.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = stored(edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = None
    while True:
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("r")).select("n", F.least("n", "r").alias("r"))
        large = both.filter("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("r").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("r"))
        small = large.join(lowest, "u").filter("v <> r").select(F.col("v").alias("u"), F.col("r").alias("v"))
        now = stored(small.unionByName(lowest.select("u", F.col("r").alias("v"))).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
