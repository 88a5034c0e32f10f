"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import checkpoint

#: Edges up to which a round runs in one task: without a shuffle, and without a file for each of many nearly empty partitions.
EDGES_A_TASK = 100_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; ``root`` is the smallest node of the component.

    Alternates two steps until no edge changes: each node hands its larger
    neighbours to the smallest one, then its smaller ones.  Every step is a
    group-by minimum and a join, so a node with many neighbours is never gathered
    in one place beyond EDGES_A_TASK edges.  Each round is checkpointed.  Null ends and
    self-links are ignored; an empty table gives an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges = checkpoint(edges)
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if tuple(now) == before or now["n"] == 0:
            break
        before = tuple(now)
        if now["n"] <= EDGES_A_TASK:
            edges = edges.coalesce(1)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        edges = checkpoint(small.select("e.u", "e.v").filter("u != v").distinct())
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
