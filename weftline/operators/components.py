"""Connected components of a graph given as links: contracted inside tasks first, then by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables

#: Links that a task contracts at a time.
HELD_LINKS = 500_000


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) as links from each node to the smallest of those that the links seen together tie it to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def hand_over() -> pa.RecordBatch:
        pairs = [(x, r) for x in root if (r := find(x)) != x]
        root.clear()
        return pa.record_batch([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            root.setdefault(u, u)
            root.setdefault(v, v)
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
        if len(root) > HELD_LINKS:
            yield hand_over()
    yield hand_over()


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) of every node of links (u, v: long) that has a link to another; component is the smallest node reachable.

    Each round ties every node's larger neighbours to its smallest one, then each node and its smaller neighbours to the
    smallest of them; minima are pre-aggregated and the rest are equi-joins, so that no node's neighbours are gathered.
    """
    e = tables.put(links.select("u", "v").mapInArrow(contracted, "u long, v long").distinct())
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u > v").union(low.select("u", "low")).distinct()
        new = tables.put(small)
        tables.drop(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
