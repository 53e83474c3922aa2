"""Registered queries of single functions and small operators, each over a whole table. Texts are built by one expression that both dialects read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import interfaces, joins, retrieval, scoring
from .queries import query, read

FENCED = "concat('```json', chr(10), p_name, '  ', chr(9), p_type, chr(10), '```')"
CODE = "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat('see ```python', chr(10), 'x = ', p_size, chr(10), CASE WHEN p_partkey % 2 = 0 THEN concat('```', chr(10), 'more ```') ELSE '' END) END"


@query(f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace({FENCED}, '^```[a-z]*', ''), '```$', ''), '\\s+', ' ', 'g')) AS bare,
  CASE WHEN p_partkey % 3 > 0 THEN 'x = ' || p_size END AS code, trim(regexp_replace(lower('  ' || p_brand || chr(9) || ' ' || p_name || ' '), '\\s+', ' ', 'g')) AS normal,
  CASE WHEN p_partkey % 10 = 0 THEN '<non-dict interface>' ELSE '@id=''dtmi:' || p_partkey || ''', displayName=' || CASE WHEN p_partkey % 4 = 0 THEN '"' || p_name || '''s"' ELSE '''' || p_name || '''' END END AS shown,
  'Name: ' || p_name || ', size: ' || CASE WHEN p_partkey % 5 > 0 THEN p_size::VARCHAR ELSE '' END || '.' AS prompt FROM part""")
def prompt_texts(spark, sf_dir):
    p, i = read(spark, sf_dir, "part"), F.col("p_partkey")
    shown = T.display_id(i % 10 > 0, F.concat(F.lit("dtmi:"), i), F.concat("p_name", F.when(i % 4 == 0, "'s").otherwise("")))
    prompt = T.fill_template("Name: {name}, size: {size}.", name=F.col("p_name"), size=F.when(i % 5 > 0, F.col("p_size")))
    return p.select("p_partkey", T.strip_fences(F.expr(FENCED)).alias("bare"), T.python_block(F.expr(CODE)).alias("code"), T.normalize(F.concat(F.lit("  "), "p_brand", F.lit("\t "), "p_name", F.lit(" "))).alias("normal"), shown.alias("shown"), prompt.alias("prompt"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END AS object, CASE WHEN event_id % 4 > 0 THEN concat('[1, ', event_id, ']') END AS list, regexp_replace(props, '\\s', '', 'g') AS small,
  concat('{"k": ', event_id, ', "ok": ', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END, ', "s": "a''b"}') AS value FROM events""")
def json_slices(spark, sf_dir):
    i = F.col("event_id")
    noisy = F.when(i % 3 == 0, F.concat(F.lit("no object: "), "event_type", F.lit(" }"))).when(i % 3 == 1, F.concat(F.lit(" Sure, "), "props", F.lit(" it is"))).otherwise(F.concat(F.lit("\n"), "props"))
    array = F.when(i % 4 == 0, "none [1, ").when(i % 4 == 1, F.concat(F.lit("[1, "), i, F.lit("]"))).otherwise(F.concat(F.lit("so [1, "), i, F.lit("] it is")))
    literal = F.concat(F.lit("{'k': "), i, F.lit(", 'ok': "), F.when(i % 2 == 0, "True").otherwise("None"), F.lit(", 's': \"a'b\"}"))
    return read(spark, sf_dir, "events").select("event_id", T.json_object_slice(noisy).alias("object"), T.json_array_slice(array).alias("list"), T.minified_json(F.col("props")).alias("small"), T.json_or_literal(literal).alias("value"))


@query("""
WITH t AS (SELECT p_partkey, p_size AS d, p_partkey::DOUBLE AS e FROM part), u AS (SELECT *, floor(d / 50 * 24)::INT AS n, floor(e / d * (50 - d))::BIGINT AS l, p_partkey AS s FROM t)
SELECT p_partkey, concat('[', repeat('#', n), repeat('-', 24 - n), '] ', d * 2, '.0% ', CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END, ' ETA ',
  CASE WHEN l >= 3600 THEN printf('%02d:%02d:%02d', l // 3600, l // 60 % 60, l % 60) ELSE printf('%02d:%02d', l // 60, l % 60) END) AS bar FROM u""")
def progress_lines(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.progress_bar(F.col("p_size"), F.lit(50), F.col("p_partkey").cast("double")).alias("bar"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unit_' || o_orderkey WHEN o_orderkey % 3 = 1 THEN regexp_replace(o_orderpriority, '[^0-9A-Za-z_]+', '_', 'g') ELSE 'part' END AS name FROM orders""")
def subsystem_names(spark, sf_dir):
    i = F.col("o_orderkey")
    ident = F.when(i % 3 == 0, F.concat(F.lit("dtmi:shop:unit-"), i, F.lit(";1"))).when(i % 3 == 1, "")
    return read(spark, sf_dir, "orders").select("o_orderkey", T.subsystem_name(ident, F.when(i % 3 == 1, F.concat(F.lit(" "), "o_orderpriority")).otherwise("  "), F.lit("part")).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || '.0' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_name WHEN 3 THEN 'True' WHEN 4 THEN (p_size % 2 = 0)::VARCHAR ELSE p_size::VARCHAR END AS value FROM part""".replace("(p_size % 2 = 0)::VARCHAR", "CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END"))
def cast_values(spark, sf_dir):
    i = F.col("p_partkey") % 6
    quoted = lambda c: F.concat(F.lit('{"v":"'), c, F.lit('"}'))
    j = F.when(i == 0, quoted(F.col("p_size"))).when(i == 1, quoted(F.concat("p_size", F.lit(".75")))).when(i == 2, quoted(F.col("p_name"))).when(i == 3, quoted(F.col("p_brand"))).when(i == 4, quoted(F.when(F.col("p_size") % 2 == 0, "yes").otherwise("No"))).otherwise(F.concat(F.lit('{"v":'), "p_size", F.lit("}")))
    schema = F.when(i == 0, "double").when(i == 1, "integer").when(i == 2, "float").when(i.isin(3, 4), "boolean").otherwise("string")
    v = V.explode_object(read(spark, sf_dir, "part").select("p_partkey", schema.alias("schema"), j.alias("j")), "j", ["p_partkey", "schema"])
    return v.select("p_partkey", V.as_text(V.cast_generated(F.col("value"), F.col("schema"))).alias("value"))


VERDICT = """CASE WHEN event_id % 7 = 0 THEN 'no verdict' ELSE concat('{"overall_result":"', CASE WHEN event_id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END, '","fields":{"a":{"result":"', CASE WHEN event_id % 3 = 0 THEN 'PASS' ELSE 'FAIL' END, '"},"b":{"result":"', CASE WHEN event_id % 5 > 0 THEN 'PASS' ELSE 'unsure' END, '"}', CASE WHEN event_id % 4 = 0 THEN ',"c":{}' ELSE '' END, '}}') END"""


@query(f"""
WITH v AS (SELECT event_id, {VERDICT} AS t FROM events), j AS (SELECT event_id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM v)
, f AS (SELECT event_id, j, [json_extract_string(j, '$.fields.' || k || '.result') FOR k IN json_keys(j, '$.fields')] AS marks FROM j)
SELECT event_id, CASE WHEN j IS NULL THEN 'error' ELSE 'ok' END AS status, coalesce(len(list_filter(marks, lambda x: x = 'PASS')), 0)::BIGINT AS tp, coalesce(len(list_filter(marks, lambda x: coalesce(x, '') <> 'PASS')), 0)::BIGINT AS fp,
  json_extract_string(j, '$.overall_result') = 'PASS' AS overall_ok FROM f""")
def verdict_counts(spark, sf_dir):
    return scoring.verdict_score(read(spark, sf_dir, "events").select("event_id", F.expr(VERDICT).alias("v")), "v", "event_id").select("event_id", "status", "tp", "fp", "overall_ok")


@query("SELECT row_idx, o_custkey, other FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS row_idx, o_custkey FROM orders) JOIN (SELECT row_number() OVER (ORDER BY o_orderkey DESC) AS row_idx, o_orderkey AS other FROM orders) USING (row_idx)")
def zip_positions(spark, sf_dir):
    """Orders by their key beside orders from the last to the first."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    first = scoring.ranked(o, "o_orderkey").select(F.col("rank").alias("row_idx"), "o_custkey")
    last = scoring.ranked(o.select((-F.col("o_orderkey")).alias("turned")), "turned").select(F.col("rank").alias("row_idx"), (-F.col("turned")).alias("other"))
    return joins.zip_rows(first, last)


@query(f"""SELECT event_id, s_name, CASE WHEN s_acctbal IS NULL THEN 'no_result' WHEN s_acctbal < 0.8 THEN 'composed' ELSE 'direct' END AS path,
  CASE WHEN event_id % 3 = 0 THEN '1,3' ELSE '1' END AS members FROM events LEFT JOIN supplier ON s_suppkey = event_id % 150 - 20""")
def hit_metadata(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 150 - 20).alias("vec_id"))
    h = joins.by_position(e, read(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "vec_id"))
    members = joins.semi_members(F.array(F.lit(1), F.lit(2), F.lit(3)), F.when(F.col("event_id") % 3 == 0, F.array(F.lit(3), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(9))))
    return h.select("event_id", "s_name", retrieval.route(F.col("s_acctbal")).alias("path"), F.array_join(members, ",").alias("members"))


@query("""
WITH h AS (SELECT c_custkey, md5('0:' || c_custkey) AS h FROM customer), n AS (SELECT c_custkey, coalesce(lead(c_custkey) OVER (ORDER BY h), first_value(c_custkey) OVER (ORDER BY h)) AS negative_key FROM h)
SELECT n.c_custkey, negative_key, c_name AS negative_name FROM n JOIN customer c ON c.c_custkey = negative_key""")
def negative_samples(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return joins.negatives(c.select("c_custkey"), "c_custkey").join(c.select(F.col("c_custkey").alias("negative_key"), F.col("c_name").alias("negative_name")), "negative_key").select("c_custkey", "negative_key", "negative_name")


INTERFACE = """concat('{"@type":"', CASE WHEN p_partkey % 5 = 0 THEN 'Twin' ELSE 'Interface' END, '","@context":"dtmi:dtdl:context;', CASE WHEN p_partkey % 7 = 0 THEN '3' ELSE '2' END, '","@id":"dtmi:', lower(p_brand), ':part', p_partkey, ';1",', CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('"displayName":"', p_name, '",') END, '"description":', CASE WHEN p_partkey % 13 = 0 THEN '1' ELSE '"d"' END, ',"contents":', CASE WHEN p_partkey % 17 = 0 THEN '{}' ELSE concat('[{"@type":"Property","name":"size"},{"@type":"Property","name":"dockerImage","schema":"', CASE WHEN p_partkey % 3 = 0 THEN 'object' ELSE 'string' END, '"},7,{"@type":"Telemetry","name":"heat","schema":"double"},{"@type":"Property","name":"k', p_size, '","schema":"integer"}]') END, '}')"""
ENTRIES = "json_extract(j, '$.contents[*]')"


@query(f"""
WITH i AS (SELECT p_partkey, ({INTERFACE})::JSON AS j FROM part), c AS (SELECT *, CASE WHEN json_type(j, '$.contents') = 'ARRAY' THEN list_filter({ENTRIES}, lambda x: json_type(x) = 'OBJECT') ELSE [] END AS e FROM i)
SELECT p_partkey, j->>'$."@type"' = 'Interface' AND j->>'$."@context"' = 'dtmi:dtdl:context;2' AND json_type(j, '$.contents') = 'ARRAY' AND coalesce(json_type(j, '$.displayName') = 'VARCHAR', FALSE) AND json_type(j, '$.description') = 'VARCHAR' AS valid,
  array_to_string([(x->>'$.name') || ':' || coalesce(x->>'$.schema', 'string') FOR x IN e IF x->>'$."@type"' = 'Property' AND x->>'$.name' <> 'dockerImage'], ',') AS properties,
  array_to_string([x->>'$.name' FOR x IN e IF x->>'$."@type"' = 'Telemetry'], ',') AS telemetry,
  CASE WHEN len(e) > 0 AND e[2]->>'$.schema' = 'string' THEN 'registry.local/dtm/shop/' || regexp_extract(j->>'$."@id"', '^dtmi:[^:;]+:([^;]+);', 1) || ':v1.0.0' END AS image FROM c""")
def interface_contents(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.expr(INTERFACE).alias("raw")).withColumn("v", F.try_parse_json("raw"))
    p = p.withColumn("e", F.coalesce(interfaces.contents(F.col("raw")), F.array().cast(f"array<{interfaces.CONTENT}>")))
    forced = interfaces.force_docker_value(F.col("e"), interfaces.get(F.col("v"), "@id"), F.lit("shop"))
    image = F.get(F.filter(forced, lambda x: x["value"].isNotNull()), F.lit(0))["value"]
    return p.select("p_partkey", interfaces.valid_interface(F.col("v")).alias("valid"), F.array_join(F.transform(interfaces.properties(F.col("e")), lambda x: F.concat(x["name"], F.lit(":"), x["schema"])), ",").alias("properties"), F.array_join(interfaces.names_of(F.col("e"), "Telemetry"), ",").alias("telemetry"), image.alias("image"))


@query("""SELECT c_custkey, c_custkey % 4 > 0 AND c_custkey % 5 > 1 AS topic, CASE c_custkey % 3 WHEN 0 THEN '{"a":' || c_custkey || '}' WHEN 1 THEN '"plain text"' ELSE '[2]' END AS payload, c_custkey % 2 = 0 AS parsed FROM customer""")
def topics_and_payloads(spark, sf_dir):
    i = F.col("c_custkey")
    topic = F.concat(F.lit('{"id":"'), F.when(i % 5 == 0, "two words").when(i % 5 == 1, "a-b").otherwise(" name "), F.lit('","title":"t"'), F.when(i % 4 == 0, "").otherwise(',"brief":"b"'), F.lit("}"))
    row = F.when(i % 3 == 0, F.concat(F.lit('{"dtdl":null,"text":"{\\"a\\":'), i, F.lit('}","content":"later"}'))).when(i % 3 == 1, '{"chunk":"plain text"}').otherwise('{"document":[2],"x":1}')
    outer = F.when(i % 2 == 0, '{"parsed":{"k":1},"raw":2}').otherwise('{"parsed":"no","raw":2}')
    inner = interfaces.unwrap_parsed(F.try_parse_json(outer))
    return read(spark, sf_dir, "customer").select("c_custkey", interfaces.valid_topic(F.try_parse_json(topic)).alias("topic"), F.to_json(interfaces.payload(F.try_parse_json(row))).alias("payload"), (F.to_json(inner) == '{"k":1}').alias("parsed"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 100")
def rows_slice(spark, sf_dir):
    return scoring.rows_between(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 500)


@query("SELECT conv_id, array_to_string(list_filter([trim(text, ' ') FOR text IN list(text ORDER BY turn)], lambda x: x <> '')[:3], '|') AS texts FROM conversations GROUP BY conv_id")
def capped_lists(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.array_join(T.capped(F.transform("t", lambda x: x["text"]), 3), "|").alias("texts"))


@query("""SELECT p_partkey, array_to_string(list_sort(['dockerImage=' || CASE WHEN p_partkey % 4 = 0 THEN 'own' ELSE 'img' END, 'interface=dtmi:' || p_partkey, 'name=' || p_name, 'heat=0', CASE WHEN p_partkey % 3 = 0 THEN 'size=0' ELSE 'size=' || p_size END]), ',') AS instance,
  array_to_string(list_sort(CASE WHEN p_partkey % 3 = 0 THEN ['name=' || p_name, 'size=0'] ELSE ['name=' || p_name, 'size=' || p_size] END), ',') AS anchor FROM part""")
def instances(spark, sf_dir):
    i = F.col("p_partkey")
    own = F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"))
    made = F.when(i % 4 == 0, F.map_concat(own, F.create_map(F.lit("dockerImage"), F.lit("own")))).otherwise(own)
    telemetry = F.when(i % 3 == 0, F.array(F.lit("heat"), F.lit("size"))).otherwise(F.array(F.lit("heat"), F.lit("heat")))
    p = read(spark, sf_dir, "part").select("p_partkey", interfaces.build_instance(F.concat(F.lit("dtmi:"), i), F.lit("img"), made, telemetry).alias("m"))
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return p.select("p_partkey", shown(F.col("m")).alias("instance"), shown(interfaces.anchor_fields(F.col("m"), F.array(F.lit("name"), F.lit("size"), F.lit("interface"), F.lit("dockerImage")))).alias("anchor"))


@query("""SELECT n_regionkey AS query_id, '{"@context":"dtmi:dtdl:context;2","@id":"dtmi:region:' || n_regionkey || ';1","@type":"Interface","displayName":"region ' || n_regionkey || '",' ||
  string_agg('"' || regexp_replace(n_name, '[^0-9A-Za-z_]', '_', 'g') || '_properties_and_telemetries":[{"type":"Property","name":"' || n_name || '"}]', ',' ORDER BY n_nationkey) || '}' AS document FROM nation GROUP BY n_regionkey""")
def composed_documents(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("position"), F.regexp_replace("n_name", "[^0-9A-Za-z_]", "_").alias("subsystem"), F.array(F.struct(F.lit("Property").alias("type"), F.col("n_name").alias("name"))).alias("entries"))
    q = F.col("query_id")
    return interfaces.composed_document(interfaces.compose(n), F.concat(F.lit("dtmi:region:"), q, F.lit(";1")), F.concat(F.lit("region "), q)).select("query_id", "document")


@query("""SELECT event_id AS query_index, CASE WHEN event_id % 3 = 0 THEN 'decompose+compose' ELSE 'direct' END AS path, length(event_type) AS query_length, event_id % 4 > 0 AND event_id % 2 = 0 AS interface_match_ok,
  CASE WHEN event_id % 4 > 0 THEN event_id % 5 END AS tp, CASE WHEN event_id % 3 = 0 THEN event_id % 7 = 0 END AS llm_verify_ok FROM events""")
def evaluation_records(spark, sf_dir):
    i = F.col("event_id")
    zero = [F.lit(0.5).alias(c) for c in ("precision", "recall", "f1")]
    e = F.when(i % 4 > 0, F.struct((i % 2 == 0).alias("overall_ok"), (i % 5).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"), *zero))
    rows = read(spark, sf_dir, "events").select(i.alias("query_index"), F.col("event_type").alias("query"), F.when(i % 3 == 0, "composed").otherwise("direct").alias("path"), i.alias("top1_faiss_id"), F.col("value").alias("top1_score"), F.lit("ok").alias("status"), F.lit(0.1).alias("route_time_seconds"), e.alias("evaluation"), (i % 7 == 0).alias("verify_ok"))
    return scoring.records(rows).select("query_index", "path", F.col("query_length").cast("long").alias("query_length"), "interface_match_ok", "tp", "llm_verify_ok")
