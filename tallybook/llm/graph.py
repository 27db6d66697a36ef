"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import materialize
from tallybook.session import as_lookup


def _to_least(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with the least neighbour of u beside it."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(as_lookup(least), "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _to_least(both).withColumn("m", F.least("m", "u"))
    return near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them. Edges run from larger to smaller."""
    near = _to_least(edges)
    moved = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Component of each linked node.

    ``links`` holds columns ``u`` and ``v`` of one orderable type; null ends and loops
    count for nothing. Returns ``node`` and ``component``, the least node it reaches, for
    all nodes but the least ones themselves. The two star steps alternate until they
    change nothing; each pass is written to the shared folder, so no lineage grows and
    nothing is gathered on the driver but a count and a checksum.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, edges = now, materialize(small_star(large_star(edges)), "edges")
