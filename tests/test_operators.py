"""Golden vectors, worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import values as V
from weftline.operators import dedup, interfaces, joins, retrieval, scoring
from weftline.plans import flows
from weftline.sources import providers, readers, sinks
from weftline.streaming import fold


def one(spark, c, **columns):
    df = spark.range(1)
    for k, v in columns.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(c.alias("c")).first()[0]


def score(spark, gold, pred):
    g = spark.createDataFrame([(0, json.dumps(gold))], "row_idx long, gold string")
    p = spark.createDataFrame([(0, pred if isinstance(pred, str) else json.dumps(pred))], "row_idx long, pred string")
    return scoring.field_summary(scoring.field_rows(g, p)).first()


def test_field_score(spark):
    gold = {"interface": "dtmi:a:b;1", "dockerImage": "r/x", "speed": 12.5, "enabled": False, "mode": "eco", "count": 0, "temp": 0}
    r = score(spark, gold, {"speed": 12.5, "enabled": False, "mode": "ECO", "count": 0})
    assert (r.tp, r.fp, r.fn) == (1, 3, 1)
    assert r.precision == 0.25 and r.recall == 0.5 and r.f1 == pytest.approx(1 / 3) and r.accuracy_union == pytest.approx(0.2) and r.em_row == 0


@pytest.mark.parametrize(("gold", "pred", "want"), [({"a": 1, "b": 2}, {"a": None}, (0, 1, 2)), ({"a": 1, "b": 2}, {"b": 2}, (1, 0, 1)), ({"a": 1}, {"a": True}, (1, 0, 0)), ({"a": 1}, {"a": "1"}, (0, 1, 1)), ({"a": 1}, {}, (0, 0, 0))])
def test_null_missing_and_kinds(spark, gold, pred, want):
    r = score(spark, gold, pred)
    assert (r.tp, r.fp, r.fn) == want


@pytest.mark.parametrize(("raw", "kind", "value"), [('" NULL "', "null", None), ('""', "null", None), ('"12"', "num", 12), ('" 1e3 "', "num", 1000), ('"1_000"', "num", 1000), ('"a—b"', "str", "a-b"), ('"a‑b"', "str", "a‑b"), ('"True"', "str", "True"), ("true", "num", 1), ('"1.5d"', "str", "1.5d")])
def test_normalized(spark, raw, kind, value):
    v = one(spark, V.normalized(V.canonical(F.parse_json("j"))), j=raw)
    assert v.kind == kind and value == {"null": None, "num": v.num, "str": v.str}[kind]


@pytest.mark.parametrize(("raw", "schema", "strict", "loose"), [('"3.9"', "integer", 3, 3), ('"abc"', "double", None, "abc"), ('"yes"', "boolean", 1, 1), ('"maybe"', "boolean", None, 1), ("null", "double", None, "None"), ("5", "string", "5", "5")])
def test_coerce(spark, raw, schema, strict, loose):
    pick = lambda v: {"null": None, "num": v.num, "str": v.str}[v.kind]
    v = V.canonical(F.parse_json("j"))
    assert pick(one(spark, V.coerce(v, F.lit(schema)), j=raw)) == strict
    assert pick(one(spark, V.cast_generated(v, F.lit(schema)), j=raw)) == loose


@pytest.mark.parametrize(("got", "allowed", "want"), [([3, 3, 9], [3, 4, 5], (2, 1, 1, False)), ([], [3, 4, 5], (0, 0, 3, True)), ([-1, 4], [3, 4, 5], (1, 0, 2, True)), ([1], None, (0, 1, 0, False))])
def test_subsystem_score(spark, got, allowed, want):
    df = spark.createDataFrame([(got, allowed)], "got array<long>, allowed array<long>")
    r = scoring.subsystem_score(df, "got", "allowed").first()
    assert (r.tp, r.fp, r.fn, r.overall_ok) == want


def test_greedy_either(spark):
    df = spark.createDataFrame([(0, "a", "X"), (1, "b", "X"), (2, "b", "Y"), (3, "c", "Y")], "o long, id string, title string")
    assert sorted(r.o for r in dedup.greedy_either(df, "o", "id", "title").collect()) == [0, 2]
    prior = df.filter("o = 0")
    assert sorted(r.o for r in dedup.greedy_after(prior, df.filter("o > 0"), "o", "id", "title").collect()) == [2]


@pytest.mark.parametrize(("text", "gold", "want"), [('```json\n{"a":1}\n```', {"a": "1"}, 0.8), ('```json {"a":1,"b":2} ```', {"a": "1", "b": "3", "c": "4"}, 0.0), ('```json {"x":1}```', {"a": "1", "b": "2"}, -1.6), ('{"a":1}', {"a": "1"}, -1), ("```json {} ```", {"a": "1"}, -1)])
def test_reward(spark, text, gold, want):
    p = spark.createDataFrame([(0, text)], "row_idx long, completion string")
    g = spark.createDataFrame([(0, json.dumps({k: int(v) for k, v in gold.items()}))], "row_idx long, gold string")
    assert scoring.reward(p, g).first().reward == pytest.approx(want)


@pytest.mark.parametrize(("f1", "attempt", "path"), [([0.5, 0.8, 0.8], 2, "composed"), ([0.2, 0.85, 0.9], 2, "composed"), ([None, None], None, "direct")])
def test_best_attempt(spark, f1, attempt, path):
    df = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(f1)], "query_id long, attempt long, f1 double")
    r = scoring.best_attempt(df).first()
    assert (r.attempt, r.path) == (attempt, path)


def test_names_and_ids(spark):
    assert [one(spark, T.safe_name(F.col("s")), s=s) for s in ("Foo Bar--baz", "!!!")] == ["Foo_Bar_baz", "subsystem"]
    assert one(spark, T.subsystem_name(F.col("s"), F.lit("d"), F.lit("f")), s="dtmi:car:brake_unit;1") == "brake_unit"
    assert [(one(spark, T.dtmi_component(F.col("s")), s=s), one(spark, T.dtmi_group(F.col("s")), s=s)) for s in ("dtmi:car:brake_unit;1", "dtmi:car")] == [("brake_unit", "car"), ("", "")]
    parts = spark.createDataFrame([(1, 1, "brake_unit", [("Property", "x")]), (1, 2, "brake_unit", [("Property", "y")])], "query_id long, position int, subsystem string, entries array<struct<type:string,name:string>>")
    assert sorted(interfaces.compose(parts).first().composed) == ["brake_unit_2_properties_and_telemetries", "brake_unit_properties_and_telemetries"]


@pytest.mark.parametrize(("s", "clock", "human"), [(65.9, "01:05", "1m06s"), (3661.0, "01:01:01", "1h01m01s"), (2.5, "00:02", "2s")])
def test_durations(spark, s, clock, human):
    assert (one(spark, T.clock(F.col("s")), s=s), one(spark, T.duration(F.col("s")), s=s)) == (clock, human)


@pytest.mark.parametrize(("n", "p", "want"), [(10, 70, 7), (1, 10, 1), (3, 50, 1)])
def test_prefix(spark, n, p, want):
    assert scoring.top_percent(spark.range(n).withColumnRenamed("id", "i"), "i", p).count() == want


def test_json_slices(spark):
    assert one(spark, T.json_object_slice(F.col("s")), s='so {"a": 1} x') == '{"a": 1}'
    assert one(spark, T.json_object_slice(F.col("s")), s="none") == "{}"
    assert one(spark, T.json_array_slice(F.col("s")), s="x [1, 2] y") == "[1, 2]"
    assert one(spark, T.json_array_slice(F.col("s")), s="x") is None


def test_interfaces(spark):
    raw = json.dumps({"@type": "Interface", "@context": interfaces.CONTEXT, "@id": "dtmi:car:brake;1", "displayName": "B", "description": "d", "contents": [{"@type": "Property", "name": "dockerImage", "schema": "string"}, {"@type": "Property", "name": "speed", "schema": "double"}, {"@type": "Telemetry", "name": "temp"}, 5]})
    df = spark.createDataFrame([(raw,), ('{"@type":"Interface"}',)], "j string").withColumn("v", F.parse_json("j"))
    assert [r[0] for r in df.select(interfaces.valid_interface(F.col("v"))).collect()] == [True, False]
    r = df.limit(1).withColumn("c", interfaces.contents(F.col("j"))).select(interfaces.properties(F.col("c")).alias("p"), interfaces.names_of(F.col("c"), "Telemetry").alias("t"), interfaces.force_docker_value(F.col("c"), F.lit("dtmi:car:brake;1"), F.lit("car")).alias("d")).first()
    assert [(x.name, x.schema) for x in r.p] == [("speed", "double")] and r.t == ["temp"] and r.d[0].value == "registry.local/dtm/car/brake:v1.0.0"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{bad\n{"a":2}\n')
    assert readers.jsonl_lenient(spark, str(tmp_path / "a.jsonl")).count() == 2
    with pytest.raises(Exception, match="bad JSON in line 3"):
        readers.jsonl_strict(spark, str(tmp_path / "a.jsonl")).select("doc").collect()
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.txt").write_text("min_per_sample=339.139648ms\n\nmin_human=28m30s\n")
    assert [tuple(r) for r in readers.stats(spark, str(tmp_path / "s")).collect()] == [("min_per_sample", 339.139648)]
    (tmp_path / "m.json").write_text('{"docs": [{"x": 1}, 2]}')
    assert [r.item for r in readers.metadata(spark, str(tmp_path / "m.json")).orderBy("pos").collect()] == ['{"x":1}', "2"]
    assert readers.done_indexes(spark, str(tmp_path / "none")).count() == 0
    sinks.append_json(spark.range(2), str(tmp_path / "o"))
    sinks.append_json(spark.range(1), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 3
    assert [r.line for r in sinks.padded_table(spark.createDataFrame([("a", 0.5)], "k string, v double"), ["k", "v"]).collect()] == ["a  0.5000"]


def test_negatives_and_zip(spark):
    r = joins.negatives(spark.range(50), "id", 3).collect()
    assert len(r) == 50 and all(x.negative_key is not None and x.negative_key != x.id for x in r)
    with pytest.raises(ValueError):
        joins.zip_rows(spark.range(2), spark.range(3), "id")


def test_knn_equals_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(60, 5)).round(3)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = e.limit(7).selectExpr("vec_id as query_id", "embedding as query_embedding")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.knn(q, e, 3).collect()}
    s = v @ v.T
    assert got == {(i, k + 1): j for i in range(7) for k, j in enumerate(np.argsort(-s[i], kind="stable")[:3])}


def test_flows(spark):
    rows = spark.createDataFrame([(0, "x", "i"), (1, "y", "none")], "row_idx long, anchor string, interface string")
    faces = spark.createDataFrame([("i", 0, [("n", "integer"), ("digest", "string")])], "interface string, idx long, fields array<struct<name:string,schema:string>>")
    out = {r.row_idx: r for r in flows.extract(rows, faces, providers.stub_generator).collect()}
    assert out[1].pred == "{}" and out[1].status == "unknown_interface"
    assert set(json.loads(out[0].pred)) == {"n", "digest"}
    e = providers.embed(spark.createDataFrame([(0, "red car"), (1, "blue sky")], "vec_id long, t string"), "t", "embedding", providers.stub_embedder)
    q = spark.createDataFrame([(7, "red car")], "query_id long, query string")
    r = flows.retrieve(q, e, providers.stub_embedder).first()
    assert (r.vec_id, r.path) == (0, "direct")


def test_strict_and_verdict(spark):
    v = scoring.verdict_score(spark.createDataFrame([(0, '{"overall_result":"PASS","fields":{"a":{"result":"PASS"},"b":{"result":"FAIL"}}}'), (1, "[1]")], "i long, v string"), "v", "i").orderBy("i").collect()
    assert (v[0].tp, v[0].fp, v[0].overall_ok, v[1].status) == (1, 1, True, "error")


def test_values_keep_their_kind(spark):
    assert score(spark, {"a": 9007199254740993}, {"a": 9007199254740992}).tp == 0 and score(spark, {"a": 1}, {"a": 1.0}).tp == 1
    shown = [one(spark, V.as_text(V.canonical(F.parse_json("j"))), j=j) for j in ("true", "1.0", "9007199254740993", "1e16", "0.00001", "12345678.5", "null", '"x"')]
    assert shown == ["True", "1.0", "9007199254740993", "1e+16", "1e-05", "12345678.5", "None", "x"]
    v = one(spark, V.cast_generated(V.canonical(F.parse_json("j")), F.lit("date")), j="5")
    assert (v.kind, v.num) == ("num", 5)
    p = spark.createDataFrame([(0, '```json\n{"k": "1"}\n```')], "row_idx long, completion string")
    assert scoring.reward(p, spark.createDataFrame([(0, '{"k": 1}')], "row_idx long, gold string")).first().reward == 0


def test_ids_and_blocks(spark):
    assert [one(spark, T.dtmi_component(F.col("s")), s=s) for s in (" dtmi:car:brake:unit;1 ", "dtmi:a:b;x")] == ["brake:unit", ""]
    assert one(spark, T.dtmi_group(F.col("s")), s="  dtmi: car :b;1") == "car"
    assert [one(spark, T.python_block(F.col("s")), s=s) for s in ("a ```python\nx = 1\n``` b", "```python\nrest ", "none")] == ["x = 1", "rest", None]
    assert one(spark, T.display_id(F.lit(True), F.lit("dtmi:a"), F.lit("B's"))) == """@id='dtmi:a', displayName="B's\""""
    assert one(spark, sinks.stats_text(F.lit(2.5), F.lit(1.0), F.lit(None).cast("double"))) == "min_seconds_per_sample=1.000000\nmax_seconds_per_sample=\navg_seconds_per_sample=2.500000\n\nmin_human=1s\nmax_human=-\navg_human=2.50s/样本"


def test_payloads(spark):
    shown = [one(spark, F.to_json(interfaces.payload(F.parse_json("j"))), j=j) for j in ('{"text":"plain words"}', '{"positive":null,"interface":{"a":1}}', '{"positive":"{\\"a\\":2}"}', '{"b":3}')]
    assert shown == ['"plain words"', '{"a":1}', '{"a":2}', '{"b":3}']


def test_a_third_part_of_a_taken_name_keeps_its_own(spark):
    rows = [(1, i + 1, n, [("Property", n + str(i))]) for i, n in enumerate(["a", "a", "a_2"])]
    parts = spark.createDataFrame(rows, "query_id long, position int, subsystem string, entries array<struct<type:string,name:string>>")
    r = interfaces.compose(parts).first()
    assert [x.subsystem_key.removesuffix(interfaces.SUFFIX) for x in r.manifest] == ["a", "a_2", "a_2_3"] and len(r.composed) == 3


@pytest.mark.parametrize(("said", "want"), [("x {'a': True, 'b': None} y", '{"a": true, "b": null}'), ('see [1, 2] and {"a": 1}', "[1, 2]"), ('{"z": 1, "a": "ü"}', '{"z": 1, "a": "ü"}'), ("(1, 2)", "[1, 2]")])
def test_json_or_literal(spark, said, want):
    assert json.loads(one(spark, T.json_or_literal(F.col("s"), strict=True), s=said)) == json.loads(want)


def test_json_or_literal_failures(spark):
    assert one(spark, T.json_or_literal(F.col("s")), s="no value at all") == "no value at all"
    with pytest.raises(Exception, match="neither JSON nor a literal"):
        one(spark, T.json_or_literal(F.col("s"), strict=True), s="no value at all")


def test_json_text_keeps_order(spark):
    text = '{ "z" : [1, 2],\n "a b" : "x  \\" y" }'
    assert one(spark, T.minified_json(F.col("s")), s=text) == json.dumps(json.loads(text), separators=(",", ":"))
    assert one(spark, T.pretty_json(F.col("s")), s='{"z":1,"a":"ü"}') == '{\n  "z": 1,\n  "a": "ü"\n}'


def test_slices_and_caps(spark, tmp_path):
    df = spark.range(1000).withColumnRenamed("id", "i")
    assert [sorted(r.i for r in scoring.rows_between(df, "i", a, n).collect()) for a, n in ((990, 0), (5, 3), (0, 2), (2000, 1))] == [list(range(990, 1000)), [5, 6, 7], [0, 1], []]
    assert scoring.rows_between(df.limit(0), "i", 0, 2).count() == 0
    assert one(spark, T.capped(F.array(*map(F.lit, [" a ", " ", "b", "c"])), 2)) == ["a", "b"]
    sinks.write_limited(df, str(tmp_path / "w"), "i", 3)
    assert sorted(r.i for r in spark.read.json(str(tmp_path / "w")).collect()) == [0, 1, 2]
    df.write.parquet(str(tmp_path / "d.parquet"))
    assert readers.dataset(spark, str(tmp_path / "d.parquet")).count() == 1000
    with pytest.raises(ValueError, match="no dataset format"):
        readers.dataset(spark, "x.csv")


def test_actions_are_named(spark):
    from weftline.operators import actions

    got = actions.run("decompose", spark.createDataFrame([(1, ["a", " ", "b", "c"])], "query_id long, parts array<string>"), most=2).collect()
    assert [(r.position, r.sub_query) for r in got] == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="no action"):
        actions.run("exec", spark.range(1))


def test_terminal_and_fan_out(spark):
    e = spark.createDataFrame([("a", 1, "assistant_chunk", None), ("a", 2, "fatal", "no model"), ("a", 3, "done", None), ("b", 1, "done", None), ("c", 1, "step_status", None)], "run_id string, seq long, type string, message string")
    got = {r.run_id: (r.failed, r.message, r.ended_at) for r in fold.terminal(e).collect()}
    assert got == {"a": (True, "no model", 2), "b": (False, None, 1), "c": (False, None, None)}
    assert fold.fan_out(e, 2).filter("reader not in (0, 1)").count() == 0


def test_records(spark):
    kind = "query_index long, query string, path string, top1_faiss_id long, top1_score double, status string, route_time_seconds double, evaluation struct<overall_ok:boolean,tp:int,fp:int,fn:int,precision:double,recall:double,f1:double>, verify_ok boolean"
    r = scoring.records(spark.createDataFrame([(0, "äb", "composed", 3, 0.5, "ok", 0.1, (True, 1, 0, 0, 1.0, 1.0, 1.0), True), (1, "x", "no_result", None, None, "no_result", None, None, None)], kind)).orderBy("query_index").collect()
    assert (r[0].path, r[0].query_length, r[0].interface_match_ok, r[0].tp, r[0].llm_verify_ok) == ("decompose+compose", 2, True, 1, True)
    # a query without a hit has no metrics; its nested record has the keys that are always there
    assert (r[1].interface_match_ok, r[1].tp, r[1].f1, r[1].tn) == (None, None, None, None)
    assert json.loads(r[1].debug) == {"query_index": 1, "query": "x", "desired_group_id": None, "path": "no_result", "status": "no_result", "route_time_seconds": None, "top1": None, "error": None}
    assert json.loads(r[0].debug)["top1"] == {"top1_faiss_id": 3, "top1_score": 0.5}
