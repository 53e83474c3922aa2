"""The fixed actions of an agent step. What a model writes is never run as code: it names one of these."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import capped
from . import interfaces, retrieval


def search(queries: DataFrame, index: DataFrame, k: int = 1) -> DataFrame:
    return retrieval.knn(queries, index, k)


def decompose(answers: DataFrame, most: int = 5) -> DataFrame:
    """query_id, position (from 1) and sub_query of answers (query_id, parts: array of text), blank ones left out, most at most."""
    return answers.select("query_id", F.posexplode(capped(F.col("parts"), most)).alias("position", "sub_query")).withColumn("position", F.col("position") + 1)


def fill(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows (query_id, key) with value of values (query_id, key, value), null where there is none."""
    return rows.join(values.select("query_id", "key", "value").dropDuplicates(["query_id", "key"]), ["query_id", "key"], "left")


def finish(steps: DataFrame) -> DataFrame:
    """Steps whose text is Finished."""
    return steps.filter(F.trim("text") == "Finished")


ACTIONS: dict[str, Callable[..., DataFrame]] = {"search": search, "decompose": decompose, "compose": interfaces.compose, "fill": fill, "finish": finish}


def run(name: str, *tables: DataFrame, **options) -> DataFrame:
    """The action of that name; a name that is none of ACTIONS is an error."""
    if name not in ACTIONS:
        raise ValueError(f"no action {name!r}; there are {', '.join(sorted(ACTIONS))}")
    return ACTIONS[name](*tables, **options)
