"""Connected components by alternating large-star and small-star (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import contracted
from .common import Shelf


def _large_star(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood."""
    both = e.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("x")))
    low = both.groupBy("n").agg(F.least(F.col("n"), F.min("x")).alias("m"))
    out = both.filter("x > n").join(low, "n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. e holds u > v."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    up = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return up.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def forest(edges: DataFrame) -> DataFrame:
    """Links (u, v: long, not null) that join the same nodes, of each task one at most for each of the nodes that it holds at a time: links within a group don't grow with its square."""
    return edges.select("u", "v").mapInArrow(contracted, "u long, v long")


def connected_components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Minima are pre-aggregated and each step is an equi-join, so a node with very many neighbours is
    never gathered. Self-loops and repeated links add nothing; null ends are dropped; no links give no rows.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    e = shelf.put(e, "links")
    mark = None
    while True:
        new = shelf.put(_small_star(_large_star(e)), "stars")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        shelf.drop(e)
        e = new
        if mark == tuple(now) or not now[0]:
            break
        mark = tuple(now)
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
