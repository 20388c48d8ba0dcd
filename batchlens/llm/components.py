"""Connected components of a graph of links, by alternating star operations.

Each round hangs every node's neighbours below its smallest neighbour, once for the
larger ones and once for the others, until only stars are left; long chains halve,
so rounds grow with the logarithm of their length.  Nothing collects a node's
neighbours: a round is a minimum per node and a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.llm.common import written



def _hang(links: DataFrame, larger: bool) -> DataFrame:
    """``links`` are (u, v) with v < u once each.  ``larger``: all neighbours count, and the larger ones move."""
    sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links
    least = written(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    if larger:
        moved = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = sides.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return written(moved.filter("u <> v").distinct())


def _mark(edges: DataFrame) -> tuple:
    """A count and a hash of a set of edges, to see whether a round changed it."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``); the root is the smallest node."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, mark = written(edges), None
    while (now := _mark(edges)) != mark:
        edges, mark = _hang(_hang(edges, True), False), now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
