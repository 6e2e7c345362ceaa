"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations by node with joins; groups are never gathered, only
their minimum is, and nodes with many neighbours are dealt to several tasks.  The number of rounds grows with the logarithm of the size.  Each
round's edges are written to the shared folder and deleted when the next are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescan.llm.common import Tables, dealt_join


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b.  Large: link larger neighbours to the least one; small: link smaller ones."""
    seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        seen = seen.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    linked = dealt_join(seen, least, "u", ["v"])
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """node, root for every node of the edges (columns a, b); root is the least node reachable.

    The result reads a table of ``tables``.
    """
    tables = tables or Tables(edges.sparkSession)
    edges = tables.put(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = mark(edges)
    while last[0]:
        half = tables.put(_star(edges, True))
        new = tables.put(_star(half, False))
        tables.drop(half)
        tables.drop(edges)
        edges = new
        if (now := mark(edges)) == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
