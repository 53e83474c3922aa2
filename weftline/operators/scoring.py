"""Scores: field counts, strict comparison, subsystem sets, verdicts, micro and macro summaries, rewards, best attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_length
from ..functions.values import almost_equal, explode_object, key, normalized
from .timing import time_stats

# Keys that no comparison counts.
IGNORED = ("@id", "displayName", "dockerImage", "interface")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def field_rows(gold: DataFrame, pred: DataFrame, index: str = "row_idx", gold_json: str = "gold", pred_json: str = "pred", tolerance: float = 0.0, zeros: bool = False) -> DataFrame:
    """One row per key of a gold or predicted object, with tp, fp, fn, required and predicted (0 or 1). Empty predictions are left out.

    Keys are required but interface and dockerImage, and unless zeros is set, those whose gold value is 0 or false.
    A mismatch is a false positive and a false negative; a predicted null is a mismatch, a missing key is not.
    """
    p = explode_object(pred, pred_json, [index])
    some = p.select(index).distinct()
    g = explode_object(gold.join(some, index, "left_semi"), gold_json, [index])
    zero = F.coalesce((F.col("value.kind") == "num") & (F.col("value.num") == 0), F.lit(False))
    g = g.filter(~F.col("key").isin("interface", "dockerImage") & (F.lit(zeros) | ~zero))
    j = g.withColumnRenamed("value", "g").withColumn("required", F.lit(1)).join(p.withColumnRenamed("value", "p").withColumn("predicted", F.lit(1)), [index, "key"], "full_outer")
    required, predicted = F.coalesce("required", F.lit(0)), F.coalesce("predicted", F.lit(0))
    tp = F.when((required == 1) & (predicted == 1) & almost_equal(F.col("g"), F.col("p"), tolerance), 1).otherwise(0)
    return j.select(index, "key", tp.alias("tp"), (predicted - tp).alias("fp"), (required - tp).alias("fn"), required.alias("required"), predicted.alias("predicted"))


def per_key(fields: DataFrame) -> DataFrame:
    return fields.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "required", "predicted")))


def empty_predictions(pred: DataFrame, pred_json: str = "pred") -> DataFrame:
    """One row: skipped, the number of rows whose prediction is the empty object, which count as not evaluated."""
    return pred.agg(F.count_if(F.size(F.json_object_keys(pred_json)) == 0).alias("skipped"))


def field_summary(fields: DataFrame, index: str = "row_idx", skipped: DataFrame | None = None) -> DataFrame:
    """One row: pooled counts, precision, recall, f1, accuracy_union, em_field, em_row, rows and, if given, skipped; ratios are 0 where undefined."""
    rows = fields.groupBy(index).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "required")))
    t = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "required")), F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"), F.count("*").alias("rows"))
    if skipped is not None:
        t = t.join(skipped, F.lit(True))  # one row each
    c = F.col
    p, r = safe_ratio(c("tp"), c("tp") + c("fp")), safe_ratio(c("tp"), c("tp") + c("fn"))
    return t.select("tp", "fp", "fn", "rows", p.alias("precision"), r.alias("recall"), safe_ratio(2 * p * r, p + r).alias("f1"), safe_ratio(c("tp"), c("tp") + c("fp") + c("fn")).alias("accuracy_union"), safe_ratio(c("tp"), c("required")).alias("em_field"), safe_ratio(c("exact"), c("rows")).alias("em_row"), *(["skipped"] if skipped is not None else []))


def strict_compare(gold: DataFrame, pred: DataFrame, index: str, gold_json: str, pred_json: str, telemetry: DataFrame | None = None) -> DataFrame:
    """Per row: tp, fp, fn, precision, recall, f1, sorted missing and extra keys, a map of key to match, overall_ok.

    Values are compared normalized; ignored keys and telemetry names (index, key) count on neither side.
    """
    sides = []
    for df, json, name in ((gold, gold_json, "g"), (pred, pred_json, "p")):
        e = explode_object(df, json, [index]).filter(~F.col("key").isin(*IGNORED))
        if telemetry is not None:
            e = e.join(telemetry.select(index, "key").distinct(), [index, "key"], "left_anti")
        sides.append(e.select(index, "key", normalized(F.col("value")).alias(name), F.lit(True).alias("in_" + name)))
    j = sides[0].join(sides[1], [index, "key"], "full_outer").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_g", "in_p")})
    j = j.withColumn("ok", F.col("in_g") & F.col("in_p") & key(F.col("g")).eqNullSafe(key(F.col("p"))))
    keys = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("key"))))
    per = j.groupBy(index).agg(
        F.count_if("ok").alias("tp"), F.count_if(F.col("in_p") & ~F.col("ok")).alias("fp"), F.count_if(F.col("in_g") & ~F.col("ok")).alias("fn"),
        keys(F.col("in_g") & ~F.col("in_p")).alias("missing"), keys(F.col("in_p") & ~F.col("in_g")).alias("extra"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "ok")))).alias("fields"),
    )
    none = {"tp": F.lit(0), "fp": F.lit(0), "fn": F.lit(0), "missing": F.array().cast("array<string>"), "extra": F.array().cast("array<string>")}
    out = gold.select(index).join(per, index, "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": safe_ratio(2 * p * r, p + r), "overall_ok": (F.col("fp") == 0) & (F.col("fn") == 0)})


def subsystem_score(df: DataFrame, retrieved: str, allowed: str, distinct: bool = False) -> DataFrame:
    """Adds tp, fp, fn, precision, recall, f1, invalid and overall_ok of an array of ids against an allowed array (null: unknown group).

    Ids below 0 are left out; repeats count unless distinct. overall_ok: no invalid id, so true if nothing was retrieved.
    """
    ids = F.filter(F.coalesce(retrieved, F.array()), lambda x: x >= 0)
    ids = F.array_distinct(ids) if distinct else ids
    good = F.coalesce(F.col(allowed), F.array())
    tp = F.size(F.filter(ids, lambda x: F.array_contains(good, x)))
    out = df.withColumn("tp", tp).withColumn("fp", F.size(ids) - F.col("tp")).withColumn("fn", F.greatest(F.lit(0), F.size(F.array_distinct(good)) - F.col("tp")))
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    reason = F.when(F.col(allowed).isNull(), "unknown group")
    return out.withColumns({"precision": p, "recall": r, "f1": safe_ratio(2 * p * r, p + r), "invalid": F.array_sort(F.array_distinct(F.array_except(ids, good))), "reason": reason, "overall_ok": (F.col("fp") == 0) & F.col(allowed).isNotNull()})


def verdict_score(df: DataFrame, verdict: str, index: str) -> DataFrame:
    """Counts of a verdict {"overall_result": PASS|FAIL, "fields": {name: {"result": PASS|FAIL}}}: a field that does not pass is fp and fn. A verdict that is no object: status error."""
    spark = df.sparkSession
    v = df.select(index, F.try_parse_json(verdict).alias("v"))
    flat = spark.sql(f"SELECT `{index}`, try_variant_get(e.value, '$.result', 'string') AS mark FROM {{v}}, LATERAL variant_explode(try_variant_get(v, '$.fields', 'variant')) e WHERE e.key IS NOT NULL", v=v)
    per = flat.groupBy(index).agg(F.count_if(F.col("mark") == "PASS").alias("tp"), F.count_if(~F.col("mark").eqNullSafe("PASS")).alias("bad"))
    ok = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    out = v.join(per, index, "left").withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("fp", F.coalesce("bad", F.lit(0)))
    return out.select(index, F.when(ok, "ok").otherwise("error").alias("status"), "tp", "fp", F.col("fp").alias("fn"), F.when(ok, F.coalesce(F.try_variant_get("v", "$.overall_result", "string") == "PASS", F.lit(False))).alias("overall_ok"))


# Keys of a nested record that are always there, and those that are there if they have a value, as they are called and the columns they are taken from.
ALWAYS = ("query_index", "query", "desired_group_id", "path", "status", "route_time_seconds", "top1", "error")
IF_ANY = {"manifest": "manifest", "direct_eval": "direct_eval", "subsystem_exact_match_eval": "subsystem_eval", "verify_eval": "verify_eval", "predicted_instance": "predicted_instance", "decompose_attempts": "decompose_attempts"}
METRICS = ("tp", "fp", "fn", "tn", "precision", "recall", "f1")


def records(df: DataFrame) -> DataFrame:
    """One flat metrics record per query (query_index, query, path, top1_faiss_id, top1_score, status, route_time_seconds, evaluation, verify_ok), and its nested debug record.

    evaluation is a struct of overall_ok and METRICS, as far as it has them, or null: then interface_match_ok is false and
    the metrics are null; a query without a hit (status no_result) has null for both. path is direct or composed;
    llm_verify_ok is told for composed ones alone. debug is JSON text with all keys of ALWAYS, null or not, and those
    of IF_ANY whose column df has and that are not null; columns of JSON text go in as they are.
    """
    e, kinds = F.col("evaluation"), dict(df.dtypes)
    path = F.when(F.col("path") == "composed", "decompose+compose").otherwise(F.col("path"))
    got = {f.name for f in df.schema["evaluation"].dataType.fields}
    kind = {c: "double" if c in ("precision", "recall", "f1") else "bigint" for c in METRICS}
    flat = [F.when(F.col("status") != "no_result", F.coalesce(e["overall_ok"], F.lit(False))).alias("interface_match_ok"), *((e[c] if c in got else F.lit(None).cast(kind[c])).alias(c) for c in METRICS)]
    verified = F.when(path == "decompose+compose", F.col("verify_ok")).alias("llm_verify_ok")

    def text(c: str) -> Column:
        return F.col(c) if kinds[c] == "string" else F.to_json(c, {"ignoreNullFields": "false"})

    top = F.when(F.col("top1_faiss_id").isNotNull(), F.struct("top1_faiss_id", "top1_score"))
    given = {"path": path, "top1": top}
    base = F.to_json(F.struct(*(given.get(c, F.col(c) if c in kinds else F.lit(None).cast("string")).alias(c) for c in ALWAYS)), {"ignoreNullFields": "false"})
    more = [F.concat(F.lit(f',"{name}":'), text(c)) for name, c in IF_ANY.items() if c in kinds]
    debug = F.concat(F.regexp_replace(base, r"\}$", ""), *(F.coalesce(m, F.lit("")) for m in more), F.lit("}"))
    return df.select("query_index", path.alias("path"), "top1_faiss_id", "top1_score", "status", query_length(F.col("query")).alias("query_length"), "route_time_seconds", *flat, verified, debug.alias("debug"))


def run_summary(records: DataFrame, run: dict[str, str | int | float | bool], seconds: str = "route_time_seconds") -> DataFrame:
    """One row on a run: what run tells of its configuration, num_paper_records and num_debug_records, and overall_time_stats, direct_time_stats and decompose_time_stats.

    Time statistics are structs of n, avg, median, p95, min and max over records that have a time; null for a path
    without records, and for no records n is 0.
    """
    counts = records.agg(F.count("*").alias("num_paper_records"), F.count("debug").alias("num_debug_records"))
    figures = F.struct("n", "avg", "median", "p95", "min", "max")
    overall = time_stats(records, seconds).select(figures.alias("overall_time_stats"))
    paths = time_stats(records, seconds, "path").groupBy().agg(*(F.first(F.when(F.col("path") == p, figures), ignorenulls=True).alias(f"{name}_time_stats") for name, p in (("direct", "direct"), ("decompose", "decompose+compose"))))
    return counts.join(overall, F.lit(True)).join(paths, F.lit(True)).select(*(F.lit(v).alias(k) for k, v in run.items()), "*")  # one row each


def summaries(records: DataFrame, path: str = "path") -> DataFrame:
    """Macro and micro metrics overall (path null, is_total) and by path, in one pass of grouping sets.

    records: tp, fp, fn, precision, recall, f1, ok. Means skip nulls, sums are 0 without values, ok_ratio counts null as false,
    micro ratios are null where undefined.
    """
    t = records.groupingSets([(), (path,)], path).agg(
        F.grouping(path).alias("is_total"), F.count("*").alias("n"), *(F.avg(c).alias("macro_" + c) for c in ("precision", "recall", "f1")), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")),
        F.try_divide(F.count_if("ok").cast("double"), F.count("*")).alias("ok_ratio"),
    )
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return t.withColumn("micro_precision", p).withColumn("micro_recall", r).withColumn("micro_f1", F.try_divide(2 * F.col("micro_precision") * F.col("micro_recall"), F.col("micro_precision") + F.col("micro_recall")))


def reward(pred: DataFrame, gold: DataFrame, index: str = "row_idx", text: str = "completion", gold_json: str = "gold", top: float = 0.8) -> DataFrame:
    """index and reward of every row of pred: its completion's fenced JSON object against the gold object of that index.

    Of the predicted keys, one is lost for each key not in gold, each unequal value and each gold key missing; top times
    what is left over the number of keys, which may be below 0. Without a fenced object, with an empty one or without
    gold: -1. Values are compared by kind, so "1" is not 1. Each side is parsed once.
    """
    # fixed value: the pattern of a fenced object
    found = pred.select(index, F.nullif(F.regexp_extract(text, r"(?s)```json\s*(\{.*?\})\s*```", 1), F.lit("")).alias("j"))
    p = explode_object(found, "j", [index]).select(index, "key", F.col("value").alias("p"), F.lit(1).alias("in_p"))
    g = explode_object(gold, gold_json, [index]).select(index, "key", F.col("value").alias("g"), F.lit(1).alias("in_g"))
    j = p.join(g, [index, "key"], "full_outer")
    n = F.count("in_p")
    lost = F.count_if(F.col("in_p").isNull() | F.col("in_g").isNull() | ~key(F.col("g")).eqNullSafe(key(F.col("p"))))
    per = j.groupBy(index).agg(n.alias("n"), (top * (n - lost) / F.nullif(n, F.lit(0))).alias("r"))
    some = gold.filter(F.coalesce(F.schema_of_variant(F.try_parse_json(gold_json)).startswith("OBJECT"), F.lit(False))).select(index).withColumn("has", F.lit(True))
    out = pred.select(index).join(per, index, "left").join(some, index, "left")
    return out.select(index, F.when((F.col("n") > 0) & F.col("has"), F.col("r")).otherwise(-1.0).alias("reward"))


def best_attempt(attempts: DataFrame, query: str = "query_id", attempt: str = "attempt", f1: str = "f1", enough: float = 0.81) -> DataFrame:
    """One row per query: the first attempt that reaches enough, else that of the largest f1, the earliest of equals. Attempts of null f1 are invalid; path is direct if all are."""
    a = attempts.groupBy(query).agg(F.min(F.when(F.col(f1) >= enough, F.col(attempt))).alias("first"), F.max(F.struct(F.col(f1).alias("f1"), (-F.col(attempt)).alias("neg"))).alias("best"))
    picked = F.coalesce("first", F.when(F.col("best.f1").isNotNull(), -F.col("best.neg")))
    return a.select(query, picked.alias("attempt"), F.when(picked.isNull(), "direct").otherwise("composed").alias("path"))


def ranked(df: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """df with rank, from 1, by the number in column order, without a task that sees all rows.

    Rows are cut at approximate quantiles of order, of which only parts numbers reach the driver; ranks are counted
    inside each part and added up over parts. Equal orders rank in some order; null orders come first.
    """
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 1000).alias("c")).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(order))) if cuts else F.lit(0)
    d = df.withColumn("__part", F.coalesce(F.when(F.col(order).isNull(), -1).otherwise(part), F.lit(-1)))
    sizes = d.groupBy("__part").agg(F.count("*").alias("n"))
    sizes = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # parts rows
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return d.withColumn("__in", inside).join(F.broadcast(sizes), "__part").withColumn("rank", F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")


def top_percent(df: DataFrame, index: str, percent: float) -> DataFrame:
    """The first max(1, floor(n * percent / 100)) rows by index."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    n = df.count()
    return ranked(df, index).filter(F.col("rank") <= max(1, int(n * percent / 100))).drop("rank")


def rows_between(df: DataFrame, index: str, start: int = 0, limit: int = 0) -> DataFrame:
    """Rows by index without the first start, limit of them at most; 0: all."""
    if start < 0 or limit < 0:
        raise ValueError("start and limit must not be negative")
    r = ranked(df, index).filter(F.col("rank") > start)
    return (r.filter(F.col("rank") <= start + limit) if limit else r).drop("rank")
