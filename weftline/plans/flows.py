"""End-to-end flows: retrieval with routing and composition, extraction with scoring, data generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill_template, json_object_slice
from ..functions.values import as_text, coerce, explode_object
from ..operators import dedup, joins, retrieval, scoring
from ..sources.providers import embed, generate

EXTRACT = "Extract the fields as one JSON object.\nFields:\n{fields}\nText:\n{anchor}\n"


def retrieve(queries: DataFrame, index: DataFrame, embedder: Callable, min_similarity: float = retrieval.MIN_SIMILARITY) -> DataFrame:
    """queries (query_id, query) with the best hit, its score and the path they take; without a hit no_result."""
    q = embed(queries, "query", "query_embedding", embedder)
    hit = retrieval.knn(q, index, 1).select("query_id", "vec_id", "score")
    return queries.join(hit, "query_id", "left").withColumn("path", retrieval.route(F.col("score"), min_similarity))


def extract(rows: DataFrame, interfaces: DataFrame, generator: Callable, done: DataFrame | None = None) -> DataFrame:
    """row_idx, status and pred of rows (row_idx, anchor, interface) by the fields of their interface (interface, idx, fields: name and schema).

    Rows in done are left out. A row whose interface is unknown, or whose answer is no object, has pred {}.
    """
    if done is not None:
        rows = joins.unfinished(rows, done, "row_idx")
    r = joins.lookup(rows, interfaces, "interface", "idx")
    fields = F.array_join(F.transform("fields", lambda x: F.format_string("- %s (%s)", x["name"], x["schema"])), "\n")
    r = generate(r.withColumn("prompt", fill_template(EXTRACT, fields=fields, anchor=F.col("anchor"))), "prompt", "answer", generator).withColumn("json", json_object_slice(F.coalesce("answer", F.lit(""))))
    got = explode_object(r, "json", ["row_idx"])
    wanted = r.select("row_idx", F.explode("fields").alias("f")).select("row_idx", F.col("f.name").alias("key"), F.col("f.schema").alias("schema"))
    cast = wanted.join(got, ["row_idx", "key"], "left").withColumn("v", coerce(F.col("value"), F.col("schema")))
    text = F.to_json(F.array("v.str"))
    shown = F.when(F.col("v.kind") == "num", F.when(F.col("v.form") == "bool", F.lower(as_text(F.col("v")))).otherwise(as_text(F.col("v")))).when(F.col("v.kind") == "str", F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(F.lit("null"))
    pairs = F.array_sort(F.collect_list(F.struct("key", shown.alias("shown"))))
    preds = cast.groupBy("row_idx").agg(F.to_json(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["key"], F.parse_json(x["shown"]))))).alias("pred"))
    status = F.when(F.col("fields").isNull(), "unknown_interface").when(F.col("json") == "{}", "no_object").otherwise("ok")
    out = r.select("row_idx", status.alias("status")).join(preds, "row_idx", "left")
    return out.withColumn("pred", F.when(F.col("status") == "ok", F.coalesce("pred", F.lit("{}"))).otherwise("{}"))


def extract_and_score(rows: DataFrame, interfaces: DataFrame, gold: DataFrame, generator: Callable) -> DataFrame:
    return scoring.field_summary(scoring.field_rows(gold, extract(rows, interfaces, generator)))


def new_topics(prior: DataFrame, rows: DataFrame) -> DataFrame:
    """prior and those of rows (order, id, title) that share neither id nor title with it or with each other."""
    return prior.unionByName(dedup.greedy_after(prior, rows, "order", "id", "title"), allowMissingColumns=True)
