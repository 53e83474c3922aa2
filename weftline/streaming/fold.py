"""Agent event streams: their source, memory, fan-out and endings. steps.py folds chunks and keeps step states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "run_id string, seq bigint, type string, step int, chunk string, output string, status string, message string"


def event_source(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """Events as JSON lines of a folder; lines that are no event are left out."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENTS).option("mode", "DROPMALFORMED").json(folder).filter("run_id is not null")


def memory(turns: DataFrame, run: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per run: what was said, role and content in order."""
    m = turns.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", F.col("text").alias("content")))).alias("m"))
    return m.select(run, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("memory"))


def fan_out(events: DataFrame, readers: int) -> DataFrame:
    """events with reader, from 0: of the readers that share a run's queue each event goes to one, the same in every run."""
    return events.withColumn("reader", F.pmod(F.xxhash64("run_id", "seq"), F.lit(readers)).cast("int"))


def terminal(events: DataFrame) -> DataFrame:
    """Per run: whether it ended with an error, the message of its first fatal event, and the seq of its one done event.

    A fatal event ends a run as well as done; what comes after the first of either counts no more.
    """
    e = events.groupBy("run_id").agg(F.min(F.when(F.col("type") == "fatal", F.col("seq"))).alias("fatal"), F.min(F.when(F.col("type") == "done", F.col("seq"))).alias("done"), F.min_by("message", F.when(F.col("type") == "fatal", F.col("seq"))).alias("message"))
    failed = F.col("fatal").isNotNull() & (F.col("done").isNull() | (F.col("fatal") < F.col("done")))
    return e.select("run_id", failed.alias("failed"), F.when(failed, F.col("message")).alias("message"), F.least("fatal", "done").alias("ended_at"))
