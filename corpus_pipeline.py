"""The corpus pipeline: toxicity, near-duplicates, mixing and packing, each stage over all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, near_dedup, packing, toxicity
from weftline.llm.common import Shelf, table
from weftline.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below the threshold. The model learns from the labelled documents among docs that are not held out; no labels: nothing goes."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each near-duplicate group (five words, 0.8), once where it is repeated; documents without words stay."""
    kept = near_dedup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("row_hash").alias("kept_hash")).distinct()
    once = docs.withColumn("row_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "row_hash"])
    return once.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row_hash") == F.col("kept_hash")), "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, a last part of it counting as once; rows that the mix doesn't take go.

    Sources that weigh less than their share give fewer rows, others up to three times as many. Equal rows are mixed as one.
    """
    taken = mixing.mix(docs).filter("taken > 0").groupBy(F.col("doc_id").alias("mix_id"), F.col("row_hash").alias("mix_hash")).agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("copies"))
    once = docs.withColumn("row_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "row_hash"])
    out = once.join(taken, F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.col("row_hash") == F.col("mix_hash")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 2048)


STAGES = [("toxicity", drop_toxic), ("near-duplicates", keep_one_of_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: No SQL says what a trained model rejects; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shelf = table(spark, sf_dir, "documents"), Shelf(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shelf.put(docs, name)
    return docs
