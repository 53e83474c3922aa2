"""Vector retrieval, routing, group indexes and triplet evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .neighbours import nearest as knn  # noqa: F401  the retrieval that routes and flows use

MIN_SIMILARITY = 0.80


def route(score: Column, min_similarity: float = MIN_SIMILARITY, metric: str = "ip", decompose: bool = True) -> Column:
    """composed for a weak best hit by inner product, if decomposing is on; no_result without a hit; else direct."""
    weak = (score < min_similarity) if decompose and metric == "ip" else F.lit(False)
    return F.when(score.isNull(), "no_result").when(weak, "composed").otherwise("direct")


def group_index(rows: DataFrame, group: str, index: str, interface: str) -> DataFrame:
    """Per group, in order of index: ids from 0, line numbers from 1 and interfaces."""
    g = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(interface).alias("x")))).alias("items"))
    return g.select(group, F.transform("items", lambda x: x["i"]).alias("ids"), F.transform("items", lambda x: x["i"] + 1).alias("line_numbers"), F.transform("items", lambda x: x["x"]).alias("interfaces"))


def triplet_metrics(triplets: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """cosine_accuracy (positive strictly nearer), mean positive, negative and metadata cosine of rows anchor, positive, negative, and what more adds.

    The metadata of a triplet are its anchor and its positive unless it has columns metadata_a and metadata_b. more holds
    aggregates over the triplets by name: that is how an evaluator is extended.
    """
    own = {"metadata_a", "metadata_b"} <= set(triplets.columns)
    pair = lambda a, b: cosine(F.col(a), F.col(b))
    t = triplets.withColumns({"__p": pair("anchor", "positive"), "__n": pair("anchor", "negative")})
    t = t.withColumn("__m", pair("metadata_a", "metadata_b") if own else F.col("__p"))
    means = [F.avg((1 - F.col("__p") < 1 - F.col("__n")).cast("double")).alias("cosine_accuracy"), F.avg("__p").alias("positive_cosine"), F.avg("__n").alias("negative_cosine"), F.avg("__m").alias("metadata_cosine")]
    return t.agg(*means, *(c.alias(name) for name, c in (more or {}).items()))


def hash_split(key: Column, parts: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 42) -> Column:
    """0, 1, 2 ...: the part a key falls in by its hash, the same in every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1e6
    out, edge = F.lit(len(parts) - 1), 1.0
    for i in range(len(parts) - 1, 0, -1):
        edge -= parts[i]
        out = F.when(u < edge, i - 1).otherwise(out)
    return out
