"""Joins: lookups with last-wins duplicates, positional joins, resume anti-joins, negative samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: that of the largest order."""
    row = F.struct(*(F.col(c).alias(c) for c in df.columns))
    return df.groupBy(key).agg(F.max_by(row, order).alias("__row")).select("__row.*")


def lookup(rows: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the columns of the last row of table that has their key; null where none has. Spark chooses the join by size."""
    return rows.join(last_wins(table, key, order).drop(order), key, "left")


def zip_rows(a: DataFrame, b: DataFrame, index: str = "row_idx") -> DataFrame:
    """a and b joined by position; an error if their numbers of rows differ, and the query fails at a position that only one of them has, or that repeats in one."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows against {m}")
    once = Window.partitionBy(index)
    sides = [d.withColumn("__n", F.count("*").over(once)).select(F.col(index).alias(f"__at{i}"), F.struct("*").alias(f"__row{i}")) for i, d in enumerate((a, b))]
    j = sides[0].join(sides[1], F.col("__at0") == F.col("__at1"), "full_outer")
    wrong = F.concat(F.lit("position "), F.coalesce(F.coalesce("__at0", "__at1").cast("string"), F.lit("null")), F.lit(": the two tables don't match row by row"))
    good = F.coalesce((F.col("__row0.__n") == 1) & (F.col("__row1.__n") == 1), F.lit(False))
    at = F.when(good, F.col("__at0")).otherwise(F.raise_error(wrong))
    rest = lambda d, i: [F.col(f"__row{i}.`{c}`").alias(c) for c in d.columns if c != index]
    return j.select(at.alias(index), *rest(a, 0), *rest(b, 1))


def unfinished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def by_position(hits: DataFrame, metadata: DataFrame, key: str = "vec_id") -> DataFrame:
    """hits with what metadata holds for their id; null for ids below 0 or past its end."""
    return hits.join(metadata, key, "left")


def semi_members(retrieved: Column, allowed: Column) -> Column:
    """What is allowed of an array, repeats kept."""
    return F.filter(retrieved, lambda x: F.array_contains(allowed, x))


def negatives(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """rows with negative_key: for each key another key, by a seeded shuffle. Alone, a key gets null.

    Keys stand in the order of the MD5 of seed:key, in parts by its first digits; each takes the next, the last of a part
    the first of the next part, and the last of all the first.
    """
    ids = rows.select(key).distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))).withColumn("part", F.left("h", F.lit(3)))
    inside = Window.partitionBy("part").orderBy("h")
    nxt = ids.withColumn("next", F.lead(key).over(inside))
    first = ids.groupBy("part").agg(F.min_by(key, "h").alias("head"))
    around = Window.orderBy("part")  # at most 4096 parts
    first = first.withColumn("after", F.coalesce(F.lead("head").over(around), F.first("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    out = nxt.join(first, "part").select(key, F.coalesce("next", "after").alias("negative_key"))
    return rows.join(out.withColumn("negative_key", F.when(F.col("negative_key") != F.col(key), F.col("negative_key"))), key, "left")
