"""Exact nearest neighbours with pruning: vectors in rings around pivots, whose bounds tell which rings a query needn't meet.

A query first meets the rings of the best bounds, which gives it a k-th score, and then only those whose bound reaches it.
Scores of a block are one matrix product; those that may be among the k best are summed again in order, so that equal
vectors have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Tables

#: Rows of the index in one block, queries that meet it in one task, and candidates that are summed again at a time.
INDEX_BLOCK, QUERY_BLOCK, AGAIN = 8_192, 4_096, 50_000
#: Pivots and rings of a pivot at most, and vectors that the pivots are fitted on, chosen by a hash of the id.
PIVOTS, RINGS, FIT_ROWS = 256, 64, 4_096


def _pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Centres of the sample by a few rounds of Lloyd's algorithm."""
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), min(wanted, len(sample)), replace=False)]
    for _ in range(6):
        near = _squared(sample, centres).argmin(axis=1)
        held = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances with an error far below the slack that bounds are given."""
    return np.sqrt(_squared(a, b))


class Rings:
    """For each ring its pivot, the least and largest distance from it, the largest norm, and how many vectors it holds."""

    def __init__(self, pivots: np.ndarray, rows: list) -> None:
        self.pivots = pivots
        self.ring, self.pivot, self.low, self.high, self.norm, self.size = (np.array(x) for x in zip(*rows, strict=True))

    def bounds(self, q: np.ndarray, metric: str) -> np.ndarray:
        """What no score of each query [m] with a vector of each ring exceeds."""
        d = _distances(q, self.pivots)[:, self.pivot]
        n = np.sqrt((q * q).sum(axis=1))[:, None]
        apart = np.maximum(0, np.maximum(d - self.high, self.low - d))
        slack = 1e-7 * (1 + n + self.norm) ** 2
        if metric == "l2":
            return -(apart**2) + slack
        about = (q @ self.pivots.T)[:, self.pivot] + n * self.high
        return np.minimum(np.minimum(about, n * self.norm), (n**2 + self.norm**2 - apart**2) / 2) + slack


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows, summed from the first component to the last."""
    s = np.zeros(len(q))
    for j in range(q.shape[1]):
        s += q[:, j] * v[:, j] if metric == "ip" else -((q[:, j] - v[:, j]) ** 2)
    return s


def best_of_block(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, metric: str, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best of one block: places in q and v, and scores. own: ids that the queries mustn't meet."""
    out = []
    square = (v * v).sum(axis=1)
    for a in range(0, len(q), 256):
        x = q[a : a + 256]
        s = x @ v.T
        size = (x * x).sum(axis=1)[:, None] + square
        s = s if metric == "ip" else 2 * s - size
        if own is not None:
            s[own[a : a + 256, None] == ids] = -np.inf
        if len(ids) > k:
            cut = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k, None]
            s = np.where(s < cut - 1e-11 * (1 + size), -np.inf, s)
        i, j = np.nonzero(s > -np.inf)
        exact = np.concatenate([np.zeros(0), *(scores(x[i[p : p + AGAIN]], v[j[p : p + AGAIN]], metric) for p in range(0, len(i), AGAIN))])
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((a + i[best], j[best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(queries: DataFrame, index: DataFrame, k: int = 1, metric: str = "ip", own: bool = True, scored: Accumulator | None = None) -> DataFrame:
    """query_id, vec_id, score and rank of the k best rows of index (vec_id, embedding) for each query (query_id, query_embedding). Exact.

    Larger scores are better: the inner product, or the negative squared distance for metric l2. Ties go to the smaller
    vec_id. A query's own vec_id counts like any other unless own is false. Ids are whole numbers. Vectors that are null,
    hold nulls, or have another length than most take no part; no vectors, or no queries: no rows. Each query id stands
    for one row. scored counts the pairs that were compared.
    """
    spark, tables = index.sparkSession, Tables(index.sparkSession, "nearest")
    schema = "query_id long, vec_id long, score double, rank int"
    whole = lambda d, i, e: d.select(F.col(i).cast("long").alias(i), F.col(e).cast("array<double>").alias(e)).filter(F.col(i).isNotNull() & F.col(e).isNotNull() & ~F.exists(e, lambda x: x.isNull()))
    index, queries = whole(index, "vec_id", "embedding"), whole(queries, "query_id", "query_embedding")
    sample = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").toArrow().column(0).combine_chunks()
    sizes, times = np.unique(np.diff(sample.offsets.to_numpy()), return_counts=True)
    if not len(sample) or not (width := int(sizes[times.argmax()])):
        return spark.createDataFrame([], schema)
    keep = np.diff(sample.offsets.to_numpy()) == width
    fit = sample.filter(pa.array(keep)).flatten().to_numpy().reshape(-1, width)
    n = index.count()
    pivots = _pivots(fit, min(PIVOTS, max(1, n // (INDEX_BLOCK // 8))))
    shared = spark.sparkContext.broadcast(pivots)

    def to_bytes(x: np.ndarray) -> pa.Array:
        x = np.ascontiguousarray(x)
        return pa.Array.from_buffers(pa.binary(width * 8), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())

    def vectors(b: pa.RecordBatch, c: str) -> np.ndarray:
        return b.column(c).flatten().to_numpy().reshape(-1, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = vectors(b, "embedding")
                d = _distances(x, shared.value)
                at = d.argmin(axis=1)
                yield pa.record_batch([b.column("vec_id"), to_bytes(x), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(x)), at]), pa.array(np.sqrt((x * x).sum(axis=1)))], ["vec_id", "vector", "pivot", "d", "norm"])

    near = tables.put(index.filter(F.size("embedding") == width).mapInArrow(assign, "vec_id long, vector binary, pivot int, d double, norm double"))
    cells = near.groupBy("pivot").agg(F.count("*").alias("rows"), F.max("d").alias("far"))
    rings = F.least(F.lit(RINGS), F.ceil(F.col("rows") / INDEX_BLOCK))
    ring = F.when(F.col("far") > 0, F.least(rings - 1, F.floor(F.col("d") / F.col("far") * rings))).otherwise(0)
    placed = near.join(F.broadcast(cells), "pivot").withColumn("ring", (F.col("pivot") * RINGS + ring).cast("int"))
    stats = placed.groupBy("ring").agg(F.first("pivot").alias("pivot"), F.min("d").alias("low"), F.max("d").alias("high"), F.max("norm").alias("norm"), F.count("*").alias("size")).orderBy("ring")
    about = [tuple(r) for r in stats.collect()]  # PIVOTS * RINGS rows at most
    if not about:
        return spark.createDataFrame([], schema)
    known = spark.sparkContext.broadcast(Rings(pivots, about))
    cuts = spark.createDataFrame([(r[0], -(-r[5] // INDEX_BLOCK)) for r in about], "ring int, cuts long")
    rows = tables.put(placed.join(F.broadcast(cuts), "ring").select("ring", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int").alias("cut"), "vec_id", "vector"))
    tables.drop(near)

    def wanted(again: bool):
        """The rings that each query meets: those of the best bounds that hold k vectors, or again those whose bounds reach the k-th score it then has."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = known.value
            for b in batches:
                if b.num_rows:
                    q = vectors(b, "query_embedding")
                    bound = r.bounds(q, metric)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    held = np.cumsum(r.size[order], axis=1)
                    first = np.zeros(bound.shape, bool)
                    np.put_along_axis(first, order, held - r.size[order] < k + (not own), axis=1)
                    met = ~first & (bound >= b.column("kth").fill_null(-np.inf).to_numpy()[:, None]) if again else first
                    i, j = np.nonzero(met)
                    yield pa.record_batch([b.column("query_id").take(pa.array(i)), to_bytes(q).take(pa.array(i)), pa.array(r.ring[j].astype(np.int32))], ["query", "q", "ring"])

        return run

    asked = queries.filter(F.size("query_embedding") == width).dropDuplicates(["query_id"]).withColumn("kth", F.lit(None).cast("double"))
    asked = tables.put(asked)
    parts = max(1, -(-asked.count() // QUERY_BLOCK))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, who = left.column("vec_id").to_numpy(), right.column("query").to_numpy()
        if scored is not None:
            scored.add(len(ids) * len(who))
        i, j, s = best_of_block(matrix(right.column("q"), width), matrix(left.column("vector"), width), ids, k, metric, None if own else who)
        return pa.table({"query_id": who[i], "vec_id": ids[j], "score": s})

    def met(asked: DataFrame, again: bool) -> DataFrame:
        """The k best of the rings that queries meet. Both sides are dealt by ring, its cut, and a part of the queries."""
        keys = ["ring", "cut", "part"]
        q = asked.mapInArrow(wanted(again), "query long, q binary, ring int").join(F.broadcast(cuts), "ring")
        q = q.select("query", "q", "ring", F.explode(F.sequence(F.lit(0), (F.col("cuts") - 1).cast("int"))).alias("cut"), F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("part"))
        q = tables.put(q)
        visited = q.select(keys).distinct()
        v = rows.join(visited, ["ring", "cut"]).select(*(F.col(c).alias("v_" + c) for c in keys), "vec_id", "vector")
        found = v.groupBy(*("v_" + c for c in keys)).cogroup(q.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
        return tables.put(found)

    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda d: d.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    first = met(asked, False)
    kth = best(first).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = met(asked.drop("kth").join(kth, "query_id", "left"), True)
    return best(first.unionByName(rest)).select("query_id", "vec_id", "score", "rank")
