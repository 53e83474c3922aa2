"""Attempts until one is good enough: each round asks only for queries that no round before has answered well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import best_attempt
from .tables import Tables

#: Rounds at most, and the F1 that ends a query's attempts.
MOST, ENOUGH = 5, 0.81


def attempt_until_good(queries: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], query: str = "query_id", f1: str = "f1", most: int = MOST, enough: float = ENOUGH) -> tuple[DataFrame, DataFrame]:
    """(best, attempts): for each query the attempt that counts and the path (see best_attempt), and all that were made.

    attempt takes the rows of queries that are still open and the round, from 1, and gives query, f1 (null: invalid) and
    what else is to be kept; it is called once a round and its result written down before the next, so that a provider
    behind it is asked once for each open query of a round. A query is open until an attempt reaches enough, for most
    rounds. Queries of which no attempt is valid take the path direct, with a null attempt. A query that repeats is one.
    """
    tables = Tables(queries.sparkSession, "attempts")
    open_ = queries = tables.put(queries.dropDuplicates([query]))
    made = None
    for i in range(1, most + 1):
        found = tables.put(attempt(open_, i).withColumn("attempt", F.lit(i)))
        made = found if made is None else made.unionByName(found)
        good = found.filter(F.col(f1) >= enough).select(F.col(query).alias("__good")).distinct()
        open_ = tables.put(open_.join(good, F.col(query).eqNullSafe(F.col("__good")), "left_anti"))
        if open_.isEmpty():
            break
    best = best_attempt(made.select(query, "attempt", f1), query, "attempt", f1, enough)
    best = queries.select(query).join(best, query, "left").withColumn("path", F.coalesce("path", F.lit("direct")))
    return best, made
