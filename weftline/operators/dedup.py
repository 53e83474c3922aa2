"""Dedup: by content hash, by the first or last of a key, and greedily by either of two keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha256
from .components import components
from .tables import Tables

#: Rows of a component that one task folds in order; larger ones are settled in rounds.
FOLD_ROWS = 200_000


def first_by_hash(rows: DataFrame, raw: str, order: str, done: DataFrame | None = None) -> DataFrame:
    """The first row of each content hash that done (column hash) doesn't hold, with its hash."""
    h = rows.withColumn("hash", sha256(F.col(raw)))
    if done is not None:
        h = h.join(done.select("hash").distinct(), "hash", "left_anti")
    first = h.groupBy("hash").agg(F.min(order).alias(order))
    return h.join(first, ["hash", order])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by component and order, the orders of those that share no key with one kept before in their component."""
    now, seen_a, seen_b = None, set(), set()
    for batch in batches:
        kept = []
        for component, order, a, b in zip(*(batch.column(c).to_pylist() for c in ("component", "order", "a", "b")), strict=True):
            if component != now:
                now = component
                seen_a.clear()
                seen_b.clear()
            if a not in seen_a and b not in seen_b:
                seen_a.add(a)
                seen_b.add(b)
                kept.append(order)
        yield pa.record_batch([pa.array(kept, batch.schema.field("order").type)], ["order"])


def greedy_either(rows: DataFrame, order: str, a: str, b: str, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Rows in order, each kept unless a kept one before it has its a or its b; rejected rows block nothing.

    order is unique; a null key equals other nulls of its column. This is the first maximal independent set by order.
    Of rows with equal keys only the first can be kept. Rows whose keys hang together are a component of the graph whose
    links they are, and components don't bear on each other: those of at most fold_rows rows are folded in order, each in
    one task, however long a chain they are. Rows of larger ones are settled in rounds: the first undecided of both its
    keys is kept, those that share a key with it go. Tables on the way are deleted as they are used up. No rows give none.
    """
    tables = Tables(rows.sparkSession, "greedy")
    plain = rows.select(F.col(order).alias("order"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    first = tables.put(plain.groupBy("a", "b").agg(F.min("order").alias("order")))
    node = lambda side: F.xxhash64(F.lit(side), F.col(side).isNull(), F.col(side))
    linked = first.select("order", "a", "b", node("a").alias("u"), node("b").alias("v"))
    named = components(linked.select("u", "v"), tables)
    linked = linked.join(named.withColumnRenamed("node", "u"), "u").select("order", "a", "b", "component")
    sizes = linked.groupBy("component").agg(F.count("*").alias("rows"))
    linked = tables.put(linked.join(sizes, "component"))
    small = linked.filter(F.col("rows") <= fold_rows).select("component", "order", "a", "b")
    kept = [tables.put(small.repartition("component").sortWithinPartitions("component", "order").mapInArrow(_folded, linked.select("order").schema))]
    left = tables.put(linked.filter(F.col("rows") > fold_rows).select("order", "a", "b"))
    while not left.isEmpty():
        new = left
        for k in ("a", "b"):
            firsts = left.groupBy(F.col(k).alias("k")).agg(F.min("order").alias("m"))
            new = new.join(firsts, F.col(k).eqNullSafe(F.col("k")) & (F.col("order") == F.col("m")), "left_semi")
        new = tables.put(new)
        kept.append(tables.put(new.select("order")))
        rest = left
        for k in ("a", "b"):
            taken = new.select(F.col(k).alias("taken")).distinct()
            rest = rest.join(taken, F.col(k).eqNullSafe(F.col("taken")), "left_anti")
        rest = tables.put(rest)
        tables.drop(left, new)
        left = rest
    tables.drop(first, linked, left)
    out = kept[0]
    for more in kept[1:]:
        out = out.union(more)
    return rows.join(out.withColumnRenamed("order", order), order, "left_semi").select(rows.columns)


def greedy_after(prior: DataFrame, rows: DataFrame, order: str, a: str, b: str) -> DataFrame:
    """Of rows, those that greedy_either keeps if all of prior were kept before them."""
    for k in (a, b):
        rows = rows.join(prior.select(F.col(k).alias("taken")).distinct(), F.col(k).eqNullSafe(F.col("taken")), "left_anti")
    return greedy_either(rows, order, a, b)
