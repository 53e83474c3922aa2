"""The registered queries over the driver's tables, and their SQL. Scores are rounded, as engines add doubles in different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions import vectors as X
from ..operators import dedup, interfaces, joins, retrieval, scoring, timing
from ..streaming import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Near the similarity of the test vectors' best hits, so that both routes are taken.
SPLIT = 0.35


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hits(spark, sf_dir, k):
    e = read(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.col("label").alias("query_label"))
    return retrieval.knn(q, e, k, own=False), q, e


HITS = """
WITH s AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.label, q.label AS query_label, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {k})
"""


@query(HITS.format(k=1) + "SELECT query_id, vec_id, round(score, 6) AS score FROM h")
def knn_top1(spark, sf_dir):
    return _hits(spark, sf_dir, 1)[0].select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(HITS.format(k=5) + "SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM h")
def knn_topk(spark, sf_dir):
    return _hits(spark, sf_dir, 5)[0].select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(HITS.format(k=1) + f"SELECT CASE WHEN score < {SPLIT} THEN 'composed' ELSE 'direct' END AS path, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(quantile_cont(score, 0.95), 6) AS p95 FROM h GROUP BY 1")
def route_summary(spark, sf_dir):
    h = _hits(spark, sf_dir, 1)[0].withColumn("path", retrieval.route(F.col("score"), SPLIT))
    t = timing.time_stats(h, "score", "path")
    return t.select("path", "n", F.round("avg", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@query("SELECT label, count(*) AS n, array_to_string(list(vec_id ORDER BY vec_id), ',') AS ids, array_to_string(list(vec_id + 1 ORDER BY vec_id), ',') AS line_numbers FROM embeddings GROUP BY label")
def group_index(spark, sf_dir):
    g = retrieval.group_index(read(spark, sf_dir, "embeddings"), "label", "vec_id", "label")
    return g.select("label", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join(F.transform("line_numbers", lambda x: x.cast("string")), ",").alias("line_numbers"))


@query(HITS.format(k=10) + """
, g AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label
), t AS (SELECT query_id, query_label, count(*) FILTER (label = query_label) AS tp, count(*) FILTER (label <> query_label) AS fp FROM h GROUP BY ALL)
SELECT query_id, tp::INT AS tp, fp::INT AS fp, (greatest(0, size - tp))::INT AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / size, 6) AS recall, fp = 0 AS overall_ok FROM t JOIN g ON g.label = t.query_label""")
def subsystem_score(spark, sf_dir):
    hits, q, e = _hits(spark, sf_dir, 10)
    groups = retrieval.group_index(e, "label", "vec_id", "label").select(F.col("label").alias("query_label"), F.col("ids").alias("allowed"))
    got = hits.groupBy("query_id").agg(F.collect_list("vec_id").alias("retrieved")).join(q.select("query_id", "query_label"), "query_id")
    s = scoring.subsystem_score(got.join(groups, "query_label", "left"), "retrieved", "allowed")
    return s.select("query_id", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "overall_ok")


@query("""
WITH m AS (SELECT count(*) AS n FROM embeddings), t AS (
  SELECT a.embedding::DOUBLE[] AS a, p.embedding::DOUBLE[] AS p, x.embedding::DOUBLE[] AS x FROM embeddings a, m
  JOIN embeddings p ON p.vec_id = (a.vec_id + 1) % n JOIN embeddings x ON x.vec_id = (a.vec_id * 7 + 3) % n)
SELECT round(avg((1 - list_cosine_similarity(a, p) < 1 - list_cosine_similarity(a, x))::INT), 6) AS cosine_accuracy, round(avg(list_cosine_similarity(a, p)), 6) AS positive_cosine, round(avg(list_cosine_similarity(a, x)), 6) AS negative_cosine FROM t""")
def triplet_eval(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    n = e.count()
    at = lambda name: e.select(F.col("vec_id").alias("i_" + name), F.col("embedding").alias(name))
    t = e.select("vec_id", F.col("embedding").alias("anchor")).join(at("positive"), F.col("i_positive") == (F.col("vec_id") + 1) % n).join(at("negative"), F.col("i_negative") == (F.col("vec_id") * 7 + 3) % n)
    m = retrieval.triplet_metrics(t)
    return m.select(*(F.round(c, 6).alias(c) for c in ("cosine_accuracy", "positive_cosine", "negative_cosine")))


def _gold_pred(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumnRenamed("event_id", "row_idx")
    k = F.get_json_object("props", "$.k").cast("long")
    gold = e.select("row_idx", F.format_string('{"interface":"i","k":%d,"type":"%s","zero":0}', k, F.col("event_type")).alias("gold"))
    i = F.col("row_idx")
    pred = e.select("row_idx", F.when(i % 11 == 0, "{}").when(i % 5 == 0, F.format_string('{"k":null,"type":"%s"}', F.col("event_type"))).when(i % 3 == 0, F.format_string('{"k":%d,"extra":1}', k)).otherwise(F.format_string('{"k":%d,"type":"%s"}', k + (i % 2), F.col("event_type"))).alias("pred"))
    return gold, pred


FIELDS = """
WITH e AS (SELECT event_id AS i, json_extract(props, '$.k')::BIGINT AS k, event_type AS t FROM events WHERE event_id % 11 <> 0), g AS (
  SELECT i, 'k' AS key, k::VARCHAR AS g FROM e WHERE k <> 0 UNION ALL SELECT i, 'type', t FROM e
), p AS (
  SELECT i, 'k' AS key, CASE WHEN i % 5 = 0 THEN 'null' WHEN i % 3 = 0 THEN k::VARCHAR ELSE (k + i % 2)::VARCHAR END AS p FROM e
  UNION ALL SELECT i, 'type', t FROM e WHERE i % 5 = 0 OR i % 3 <> 0 UNION ALL SELECT i, 'extra', '1' FROM e WHERE i % 5 <> 0 AND i % 3 = 0
), j AS (SELECT coalesce(g.i, p.i) AS i, coalesce(g.key, p.key) AS key, g.i IS NOT NULL AS r, p.i IS NOT NULL AS q, coalesce(g.g = p.p, false) AS same FROM g FULL JOIN p ON g.i = p.i AND g.key = p.key
), f AS (SELECT i, key, (r AND q AND same)::INT AS tp, q::INT - (r AND q AND same)::INT AS fp, r::INT - (r AND q AND same)::INT AS fn, r::INT AS required, q::INT AS predicted FROM j)
"""


@query(FIELDS + """, t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(required)::BIGINT AS required FROM f
), r AS (SELECT count(*) AS rows, count(*) FILTER (a = 0 AND b = 0) AS exact FROM (SELECT i, sum(fp) AS a, sum(fn) AS b FROM f GROUP BY i))
SELECT tp, fp, fn, rows, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS accuracy_union, round(tp / required, 6) AS em_field, round(exact / rows, 6) AS em_row FROM t, r""")
def field_score(spark, sf_dir):
    s = scoring.field_summary(scoring.field_rows(*_gold_pred(spark, sf_dir)))
    return s.select(*(F.round(c, 6).alias(c) if k == "double" else c for c, k in s.dtypes))


@query(FIELDS + "SELECT key, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(required)::BIGINT AS required, sum(predicted)::BIGINT AS predicted FROM f GROUP BY key")
def field_score_per_key(spark, sf_dir):
    return scoring.per_key(scoring.field_rows(*_gold_pred(spark, sf_dir)))


@query("SELECT p_partkey AS row_idx, 2 + (p_partkey % 4 <> 1)::INT AS tp, (p_partkey % 4 = 1)::INT AS fp, (p_partkey % 4 = 1)::INT + (p_partkey % 3 = 0)::INT AS fn, CASE WHEN p_partkey % 3 = 0 THEN 'note' ELSE '' END AS missing, p_partkey % 4 <> 1 AND p_partkey % 3 <> 0 AS overall_ok FROM part")
def strict_compare_normalized(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"))
    i = F.col("row_idx")
    gold = p.select("row_idx", F.concat(F.lit('{"@id":"x","n":"'), i, F.lit('","name":"well—known  item","flag":'), F.when(i % 4 == 1, F.lit("true")).otherwise(F.lit('"NONE"')), F.when(i % 3 == 0, F.lit(',"note":"a"')).otherwise(""), F.lit("}")).alias("gold"))
    pred = p.select("row_idx", F.concat(F.lit('{"n":'), i, F.lit('.0,"name":" well-known item ","flag":'), F.when(i % 4 == 1, F.lit('"true"')).otherwise(F.lit('""')), F.lit("}")).alias("pred"))
    s = scoring.strict_compare(gold, pred, "row_idx", "gold", "pred")
    return s.select("row_idx", *(F.col(c).cast("int").alias(c) for c in ("tp", "fp", "fn")), F.array_join("missing", ",").alias("missing"), "overall_ok")


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events""")
def json_extract_fenced(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    said = F.when(i % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nbye }"))).when(i % 3 == 1, F.concat(F.lit("It is "), "props", F.lit(" so."))).otherwise(F.concat(F.lit("  "), "props", F.lit(" ")))
    j = T.json_fenced_or_braced(said)
    return e.select("event_id", F.get_json_object(j, "$.k").cast("long").alias("k"), F.array_join(F.array_sort(F.json_object_keys(j)), ",").alias("keys"))


@query("""WITH p AS (SELECT p_partkey, 'dtmi:' || CASE WHEN p_partkey % 7 = 0 THEN 'one' ELSE lower(p_brand) || ':' || p_partkey || '-' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ':unit' ELSE '' END || ';1' END AS id, p_name || '  --' || p_brand AS n FROM part)
SELECT p_partkey, regexp_extract(id, '^dtmi:([^:;]+):([^;]+);[0-9]+$', 2) AS component, CASE WHEN len(string_split(id, ':')) >= 3 THEN string_split(id, ':')[2] ELSE '' END AS grp,
  regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(n, '[^0-9A-Za-z_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), '^$', 'subsystem') AS safe FROM p""".replace("\\\\d", "\\d"))
def dtmi_parse(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    ident = F.concat(F.lit("dtmi:"), F.when(F.col("p_partkey") % 7 == 0, "one").otherwise(F.concat(F.lower("p_brand"), F.lit(":"), "p_partkey", F.lit("-"), "p_size", F.when(F.col("p_partkey") % 3 == 0, ":unit").otherwise(""), F.lit(";1"))))
    return p.select("p_partkey", T.dtmi_component(ident).alias("component"), T.dtmi_group(ident).alias("grp"), T.safe_name(F.concat("p_name", F.lit("  --"), "p_brand")).alias("safe"))


@query("""
WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem
), l AS MATERIALIZED (SELECT l_orderkey AS o, i, regexp_replace(p_brand, '[^0-9A-Za-z_]', '_', 'g') AS b FROM n JOIN part ON l_partkey = p_partkey
), k AS (
  SELECT o, i, [b || '_properties_and_telemetries'] AS keys FROM l WHERE i = 1
  UNION ALL SELECT l.o, l.i, list_append(k.keys, CASE WHEN list_contains(k.keys, l.b || '_properties_and_telemetries') THEN l.b || '_' || l.i ELSE l.b END || '_properties_and_telemetries') FROM k JOIN l ON l.o = k.o AND l.i = k.i + 1
)
SELECT o AS query_id, max(i) AS parts, array_to_string(arg_max(keys, i), ',') AS keys FROM k GROUP BY o""")
def compose_manifest(spark, sf_dir):
    return _manifests(spark, sf_dir, read(spark, sf_dir, "lineitem"))


def _manifests(spark, sf_dir, lines):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    l = lines.withColumn("place", place).join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    entry = F.array(F.struct(F.lit("Property").alias("type"), F.col("p_name").alias("name")))
    c = interfaces.compose(l.select(F.col("l_orderkey").alias("query_id"), F.col("place").alias("position"), F.regexp_replace("p_brand", "[^0-9A-Za-z_]", "_").alias("subsystem"), entry.alias("entries")))
    return c.select("query_id", F.size("manifest").cast("long").alias("parts"), F.array_join(F.transform("manifest", lambda x: x["subsystem_key"]), ",").alias("keys"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY sha256(text)")
def dedup_sha256(spark, sf_dir):
    return dedup.first_by_hash(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "hash")


@query("SELECT doc_id, lang FROM documents d ANTI JOIN labels l USING (doc_id)")
def resume_anti_join(spark, sf_dir):
    return joins.unfinished(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT c_custkey, c_name, max(o_orderkey) AS last_order, arg_max(o_orderstatus, o_orderkey) AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def last_wins_lookup(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderkey").alias("last_order"), F.col("o_orderstatus").alias("status"))
    return joins.lookup(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, "c_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= greatest(1, (SELECT count(*) FROM orders) * 70 // 100)")
def top_percent_prefix(spark, sf_dir):
    return scoring.top_percent(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 70)


@query("""
WITH r AS (SELECT lang AS path, quality AS tp, 1 - quality AS fp, toxic AS fn, quality = 1 AND toxic = 0 AS ok, CASE WHEN doc_id % 3 > 0 THEN quality::DOUBLE END AS precision FROM labels JOIN documents USING (doc_id))
SELECT path, grouping(path)::INT AS is_total, count(*) AS n, round(avg(precision), 6) AS macro_precision, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(count(*) FILTER (ok) / count(*), 6) AS ok_ratio,
  round(sum(tp) / sum(tp + fp), 6) AS micro_precision, round(sum(tp) / nullif(sum(tp + fn), 0), 6) AS micro_recall FROM r GROUP BY GROUPING SETS ((), (path))""")
def macro_micro_grouping_sets(spark, sf_dir):
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    p = F.when(F.col("doc_id") % 3 > 0, F.col("quality").cast("double"))
    r = d.select(F.col("lang").alias("path"), F.col("quality").alias("tp"), (1 - F.col("quality")).alias("fp"), F.col("toxic").alias("fn"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("ok"), p.alias("precision"), p.alias("recall"), p.alias("f1"))
    s = scoring.summaries(r)
    return s.select("path", F.col("is_total").cast("int").alias("is_total"), "n", F.round("macro_precision", 6).alias("macro_precision"), "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("ok_ratio", "micro_precision", "micro_recall")))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def time_stats(spark, sf_dir):
    t = timing.time_stats(read(spark, sf_dir, "events"), "value", "event_type")
    return t.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("avg", "median", "p95")), "min", "max")


@query("WITH e AS (SELECT event_id, user_id, round(value * 100)::BIGINT AS ms FROM events) SELECT event_id, row_number() OVER w AS done, avg(ms) OVER w AS running_avg, avg(ms) OVER w * (count(*) OVER (PARTITION BY user_id) - row_number() OVER w) AS eta FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_eta(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("ms"))
    return timing.running_stats(e, "user_id", "event_id", "ms").select("event_id", "done", "running_avg", "eta")


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, CASE WHEN event_id % 4 > 0 THEN (event_id * 37 % 100) / 100.0::DOUBLE END AS f1 FROM events
), b AS (SELECT user_id, min(attempt) FILTER (f1 >= 0.81) AS first, arg_max(attempt, f1 * 1e6 - attempt) AS best, max(f1) AS f FROM e GROUP BY user_id)
SELECT user_id AS query_id, CASE WHEN f IS NULL THEN NULL ELSE coalesce(first, best) END AS attempt, CASE WHEN f IS NULL THEN 'direct' ELSE 'composed' END AS path FROM b""")
def best_attempt(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("attempt"), F.when(F.col("event_id") % 4 > 0, (F.col("event_id") * 37 % 100) / 100).alias("f1"))
    return scoring.best_attempt(e)


def _said(i, k, kind):
    """A completion on a row of events, as SQL text: some without a fence, some with values of another kind, some with other keys."""
    return f"CASE WHEN {i} % 6 = 0 THEN concat('{{\"k\":', {k}, '}}') ELSE concat('ok ```json\n{{\"k\":', CASE WHEN {i} % 6 = 1 THEN concat('\"', {k}, '\"') WHEN {i} % 6 = 4 THEN '-1' ELSE {k} END, CASE WHEN {i} % 6 IN (2, 5) THEN concat(',\"x\":', {i} % 3) ELSE '' END, CASE WHEN {i} % 4 = 1 THEN concat(',\"t\":\"', {kind}, '\"') ELSE '' END, '}}\n```') END"


@query("""
WITH e AS (SELECT event_id AS i, json_extract_string(props, '$.k') AS k, event_type AS t FROM events
), s AS (SELECT i, concat('{"k":', k, ',"t":"', t, '"', CASE WHEN i % 2 = 0 THEN ',"x":1' ELSE '' END, '}')::JSON AS g, nullif(regexp_extract(""" + _said("i", "k", "t").replace("\n", "' || chr(10) || '") + """, '```json[[:space:]]*([{].*?[}])[[:space:]]*```', 1, 's'), '')::JSON AS p FROM e
), pk AS (SELECT i, unnest(json_keys(p)) AS key FROM s WHERE p IS NOT NULL), gk AS (SELECT i, unnest(json_keys(g)) AS key FROM s
), j AS (SELECT coalesce(pk.i, gk.i) AS i, pk.key AS a, gk.key AS b FROM pk FULL JOIN gk ON pk.i = gk.i AND pk.key = gk.key
), v AS (SELECT j.i, a, b, json_extract(p, '$.' || a) AS x, json_extract(g, '$.' || b) AS y FROM j JOIN s ON s.i = j.i
), c AS (SELECT i, count(a) AS n, count(*) FILTER (a IS NULL OR b IS NULL OR x::VARCHAR <> y::VARCHAR) AS lost FROM v GROUP BY i)
SELECT i AS event_id, round(CASE WHEN n > 0 THEN 0.8 * (n - lost) / n ELSE -1.0 END::DOUBLE, 6) AS reward FROM c""")
def reward(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("row_idx"), F.get_json_object("props", "$.k").alias("k"), "event_type")
    pred = e.select("row_idx", F.expr(_said("row_idx", "k", "event_type")).alias("completion"))
    gold = e.select("row_idx", F.expr("""concat('{"k":', k, ',"t":"', event_type, '"', CASE WHEN row_idx % 2 = 0 THEN ',"x":1' ELSE '' END, '}')""").alias("gold"))
    r = scoring.reward(pred, gold)
    return r.select(F.col("row_idx").alias("event_id"), F.round("reward", 6).alias("reward"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS memory FROM conversations GROUP BY conv_id")
def chat_memory_fold(spark, sf_dir):
    m = fold.memory(read(spark, sf_dir, "conversations"))
    return m.select("conv_id", F.size("memory").cast("long").alias("turns"), F.array_join(F.transform("memory", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("memory"))


@query()
def greedy_dedup(spark, sf_dir):
    """Documents with the same first word, or the same length and source, as a kept one before them go."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring_index(F.lower("text"), " ", 2).alias("title"), F.concat_ws("-", "source", "n_chars").alias("key"))
    return dedup.greedy_either(d, "doc_id", "key", "title").select("doc_id")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey + (p_partkey % 2) * 0.5)::DOUBLE END AS number, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey::DOUBLE END AS whole,
  CASE WHEN p_partkey < 3600 THEN printf('%02d:%02d', p_partkey // 60, p_partkey % 60) ELSE printf('%02d:%02d:%02d', p_partkey // 3600, p_partkey // 60 % 60, p_partkey % 60) END AS clock FROM part""")
def coerce_values(spark, sf_dir):
    i = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(i % 5 == 0, F.lit('{"v":"abc"}')).when(i % 2 == 1, F.concat(F.lit('{"v":" '), i, F.lit('.5"}'))).otherwise(F.concat(F.lit('{"v":'), i, F.lit("}"))).alias("j"))
    v = V.explode_object(p, "j", ["p_partkey"])
    return v.select("p_partkey", V.coerce(F.col("value"), F.lit("double"))["num"].alias("number"), V.coerce(F.col("value"), F.lit("integer"))["num"].alias("whole"), T.clock(i.cast("double")).alias("clock"))


@query("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12), 6) AS length FROM embeddings")
def l2_normalized(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(X.dot(X.l2_normalize(F.col("embedding")), F.col("embedding")), 6).alias("length"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < DATE '1997-01-01' GROUP BY ALL""")
def relational_smoke(spark, sf_dir):
    l, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").filter("o_orderdate < date'1997-01-01'").select("o_orderkey")  # noqa: E741
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).cast("double").alias("revenue"))
