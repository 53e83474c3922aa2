"""Splits of exact sizes: the first so many keys by a hash, whose limit is found by counting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits that one pass tells apart; it brings 16 to that power counts to the driver.
DIGITS = 3


def hash_of(key: str, seed: int) -> Column:
    """32 hexadecimal digits, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def limit_of(hashes: DataFrame, first: int) -> str:
    """What is at least as large as the beginnings of exactly first of the distinct hashes (column h), and of no more; '' for none."""
    if first <= 0:
        return ""
    prefix, left = "", first
    while True:
        n = len(prefix) + DIGITS
        counts = hashes.filter(F.col("h").startswith(prefix)).groupBy(F.substring("h", 1, n).alias("p")).count().orderBy("p").collect()
        for p, m in counts:
            if m >= left:
                break
            left -= m
        else:
            return "g"  # as many as there are, or fewer
        if m == left:
            return p
        prefix = p


def split_exact(df: DataFrame, key: str, held_out: float = 0.2, test: float = 0.5, seed: int = 42) -> DataFrame:
    """Adds part, train or eval, and in_test: eval holds exactly ceil(held_out * n) of the n distinct keys and the test set, which is part of it, ceil(test * that).

    Rows of one key stay together, null is a key like another. The same keys and seed give the same sets, in any order and
    on any number of machines. No rows are gathered: each pass counts hashes by their next DIGITS digits, in the range
    that the limit lies in.
    """
    hashes = df.select(hash_of(key, seed).alias("h")).distinct()
    n = hashes.count()
    n_eval = math.ceil(round(held_out * n, 9))
    n_test = math.ceil(round(test * n_eval, 9))

    def below(first: int) -> Column:
        limit = limit_of(hashes, first)
        return F.substring(hash_of(key, seed), 1, max(1, len(limit))) <= limit if limit else F.lit(False)

    return df.withColumn("part", F.when(below(n_eval), "eval").otherwise("train")).withColumn("in_test", below(n_test))
