"""Connected components of a graph of distinct nodes, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bootloom.operators.lineage import drop_settled, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (``u``, ``v``) that is not the least node of its component.

    Every round replaces paths by shorter ones, so a chain of n nodes takes about
    log n rounds.  A round is a few grouped joins over the edges; each one is
    written to the shared folder, and its two figures on the driver (rows and a
    hash of all edges) tell whether anything has changed.
    """
    oriented = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    known, before = settle(oriented), None
    while True:
        state = known.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return known.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        after = settle(_small_star(_large_star(known)))
        drop_settled(known)
        known = after
