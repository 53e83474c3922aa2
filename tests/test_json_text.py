"""Strict JSON: order, repeated keys, NaN, trailing text; and the operators that read it."""

import json
import random

from pyspark.sql import functions as F

from weftline.functions import json_text as J
from weftline.functions import text as T
from weftline.functions import values as V
from weftline.operators import interfaces, scoring
from weftline.plans import flows
from weftline.sources import providers


def column(spark, texts, c):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2).select(c.alias("x"), "i").orderBy("i").collect()]


def test_shapes(spark):
    texts = ['{"a":1}', '{"a":1} x {"b":2}', '{"a":1,"a":2}', "[1, 2]", "[1] 2", " 7 ", "NaN", '{"a": NaN, "b": -Infinity}', "", None, "{'a': 1}", '{"a":1', "[" * 100_000]
    assert column(spark, texts, J.json_shape("t")) == ["object", None, "object", "array", None, "other", "other", "object", None, None, None, None, None]
    assert column(spark, texts[:3], T.json_object_slice(F.col("t"))) == ['{"a":1}', "{}", '{"a":1,"a":2}']


def test_entries_keep_order_and_the_last_of_repeated_keys(spark):
    texts = ['{"z":1,"a":[1,{"y":2,"x":null}],"z":"é","b":true,"n":null,"big":9007199254740993,"f":1.5,"nan":NaN}', "{}", "[]", "bad", None]
    got = column(spark, texts, J.object_entries("t"))
    assert [[e.key for e in r] if r is not None else None for r in got] == [["z", "a", "b", "n", "big", "f", "nan"], [], None, None, None]
    values = {e.key: e.value for e in got[0]}
    assert (values["z"].str, values["a"].str, values["b"].num, values["n"].kind, int(values["big"].whole), values["f"].num) == ("é", '[1,{"x":null,"y":2}]', 1.0, "null", 9007199254740993, 1.5)
    assert values["nan"].num != values["nan"].num
    assert [[(e.key, e.json) for e in r] for r in column(spark, texts[:1], J.object_items("t"))] == [[("z", '"é"'), ("a", '[1,{"y":2,"x":null}]'), ("b", "true"), ("n", "null"), ("big", "9007199254740993"), ("f", "1.5"), ("nan", "NaN")]]
    assert column(spark, ['[1, {"b": [2], "a": "x y"}, null]', "{}"], J.list_items("t")) == [["1", '{"b":[2],"a":"x y"}', "null"], None]


def test_canonical_equals_the_variant_form(spark):
    """Both ways of reading agree on what both can read."""
    r = random.Random(2)
    docs = [{f"k{i}": r.choice([None, True, False, r.randint(-5, 5), r.random(), 2**53 + i, -(2**60) - i, 10**25, "text", "", "1", "é\n", 0, 1.0, 1e300, -2.5e-7]) for i in range(6)} for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string")
    a = {(x.i, x.key): tuple(x.value)[:4] for x in V.explode_object(df, "j", ["i"]).collect()}
    rows = spark.sql("SELECT i, e.key, e.value AS x FROM {p}, LATERAL variant_explode(v) e", p=df.select("i", F.try_parse_json("j").alias("v")))
    b = {(x.i, x.key): tuple(x.value)[:4] for x in rows.select("i", "key", V.canonical(F.col("x")).alias("value")).collect()}
    assert a == b


def test_a_repeated_key_is_scored_by_its_last_value(spark):
    gold = spark.createDataFrame([(0, '{"a":2,"b":3}')], "row_idx long, gold string")
    pred = spark.createDataFrame([(0, '{"a":1,"a":2}')], "row_idx long, pred string")
    r = scoring.field_summary(scoring.field_rows(gold, pred)).first()
    assert (r.rows, r.tp, r.fp, r.fn) == (1, 1, 0, 1)


def test_subsystems_in_the_documents_order(spark):
    s = interfaces.SUFFIX
    doc = json.dumps({"z" + s: [{"@type": "Property", "name": "p2"}, 5], "a" + s: [{"type": "Telemetry", "name": "t", "value": 1}, {"@type": "Property", "name": "p1", "schema": "double"}, {"@type": "Property", "name": "dockerImage"}], "no" + s: {}})
    names = column(spark, [doc], F.transform(interfaces.contents(F.col("t")), lambda x: x["name"]))
    assert names == [["p2", "t", "p1", "dockerImage"]]
    assert [[x.key.removesuffix(s) for x in r] for r in column(spark, [doc], interfaces.subsystem_blocks(F.col("t")))] == [["z", "a"]]
    assert [[x.name for x in r] for r in column(spark, [doc], interfaces.properties(interfaces.contents(F.col("t")), image=True))] == [["p2", "p1", "dockerImage"]]


def test_templates_are_filled_once(spark):
    df = spark.createDataFrame([("x {size} y", 7)], "name string, size int")
    assert df.select(T.fill_template("A {name} B {size} {other} {name}", name=F.col("name"), size=F.col("size"))).first()[0] == "A x {size} y B 7 {other} x {size} y"


def test_extracted_fields_are_json_whatever_their_names(spark):
    rows = spark.createDataFrame([(0, "x", "i")], "row_idx long, anchor string, interface string")
    faces = spark.createDataFrame([("i", 0, [('odd"]:,["', "string"), ("n", "integer"), ("digest", "string")])], "interface string, idx long, fields array<struct<name:string,schema:string>>")
    (r,) = flows.extract(rows, faces, providers.stub_generator).collect()
    got = json.loads(r.pred)
    assert set(got) == {'odd"]:,["', "n", "digest"} and got['odd"]:,["'] is None and isinstance(got["n"], int)
