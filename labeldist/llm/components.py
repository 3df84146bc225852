"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeldist.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``(node, component)`` per linked node; the component is its smallest node.

    Alternating large and small stars: every node ties its larger neighbours to
    the smallest node that it knows, then its smaller ones, until all links are
    ties to the smallest node of their component.  Each round is two joins
    on the node, written to the shared folder; nothing is collected.
    """
    edges = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return roots.union(edges.select(F.col("u").alias("node"), F.col("v").alias("component")))
