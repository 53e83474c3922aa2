"""Readers, sinks and joins that no query reaches."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import interfaces, joins
from weftline.plans import flows
from weftline.sources import readers, sinks


def test_objects_of_a_text(spark):
    df = spark.createDataFrame([(0, '{"a":1}\n\n oops \r\n{"b":2}'), (1, None), (2, "[1]\n{\"c\":3} x")], "i int, t string")
    good, bad = readers.text_objects(df, "t")
    assert sorted((r.i, r.line_idx, r.line) for r in good.collect()) == [(0, 0, '{"a":1}'), (0, 3, '{"b":2}')]
    assert sorted((r.i, r.line) for r in bad.collect()) == [(0, "oops"), (2, "[1]"), (2, '{"c":3} x')]


def test_key_sets_and_done_indexes(spark, tmp_path):
    (tmp_path / "k.txt").write_text(" a \n\nb\na\n")
    assert sorted(r.key for r in readers.key_set(spark, str(tmp_path / "k.txt")).collect()) == ["a", "b"]
    (tmp_path / "d.txt").write_text("3\n x\n 4 \n3\n\n1.5\n-2\n")
    assert sorted(r.row_idx for r in readers.done_indexes(spark, str(tmp_path / "d.txt")).collect()) == [-2, 3, 4]


def test_prediction_files_and_labels(spark, tmp_path):
    for place in ("m1/b.jsonl", "m0/a.jsonl", "m0/c.txt", "top.jsonl"):
        (tmp_path / place).parent.mkdir(exist_ok=True)
        (tmp_path / place).write_text("{}\n")
    rows = readers.prediction_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 2)[1:], r.label) for r in rows] == [(["m0", "a.jsonl"], "m0"), (["m1", "b.jsonl"], "m1")]
    assert spark.createDataFrame([("/alone.jsonl",), ("alone.jsonl",), ("/x/y/f.jsonl",)], "p string").select(readers.label_of(F.col("p"))).toPandas().iloc[:, 0].tolist() == ["alone", "alone", "y"]


def test_datasets_and_vectors(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    spark.range(4).withColumnRenamed("id", "vec_id").write.parquet(str(tmp_path / "x.parquet"))
    assert [readers.dataset(spark, str(tmp_path / f"x.{e}")).count() for e in ("json", "jsonl", "parquet")] == [2, 3, 4]
    with pytest.raises(ValueError):
        readers.dataset(spark, "x.csv")
    df, warning = readers.vectors(spark, str(tmp_path / "x.parquet"), 4)
    assert df.count() == 4 and warning is None
    assert readers.vectors(spark, str(tmp_path / "x.parquet"), 5)[1] == "4 vectors, but 5 rows of metadata"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.vectors(spark, str(tmp_path / "none"))


def test_documents_keys_and_truncation(spark, tmp_path):
    df = spark.createDataFrame([("é", None, [1, 2])], "z string, a string, l array<int>")
    sinks.overwrite_document(df, str(tmp_path / "doc"))
    sinks.overwrite_document(df, str(tmp_path / "doc"))
    (file,) = (tmp_path / "doc").glob("part-*")
    assert file.read_text() == json.dumps({"z": "é", "a": None, "l": [1, 2]}, ensure_ascii=False, indent=2) + "\n"
    sinks.append_keys(spark.range(3), "id", str(tmp_path / "keys"))
    sinks.append_keys(spark.range(2, 4), "id", str(tmp_path / "keys"))
    assert sorted(r.row_idx for r in readers.done_indexes(spark, str(tmp_path / "keys")).collect()) == [0, 1, 2, 3]
    sinks.append_json(spark.range(3), str(tmp_path / "rows"))
    sinks.truncate(spark.range(3), str(tmp_path / "rows"))
    assert not any(p.read_text() for p in (tmp_path / "rows").glob("part-*"))
    sinks.append_json(spark.range(2), str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 2
    sinks.write_limited(spark.range(20).withColumnRenamed("id", "i"), str(tmp_path / "some"), "i", 7)
    assert sorted(r.i for r in spark.read.json(str(tmp_path / "some")).collect()) == list(range(7))


def test_positions_must_match(spark):
    two = lambda *at: spark.createDataFrame([(i, f"r{i}") for i in at], "row_idx long, v string")
    assert sorted(map(tuple, joins.zip_rows(two(0, 1), two(1, 0).withColumnRenamed("v", "w")).collect())) == [(0, "r0", "r0"), (1, "r1", "r1")]
    for a, b in ((two(0, 1), two(0, 2)), (two(0, 0), two(0, 1)), (two(0, 1), two(0, None))):
        with pytest.raises(Exception, match="don't match row by row"):
            joins.zip_rows(a, b.withColumnRenamed("v", "w")).collect()


def test_new_topics(spark):
    kind = "`order` long, id string, title string"
    prior = spark.createDataFrame([(0, "a", "X")], kind)
    rows = spark.createDataFrame([(1, "a", "N"), (2, "b", "X"), (3, "b", "Y"), (4, "c", "Y"), (5, "d", "Z")], kind)
    assert sorted(r.id for r in flows.new_topics(prior, rows).collect()) == ["a", "b", "d"]


def test_schema_spec_and_payload(spark):
    blocks = spark.createDataFrame([({"b" + interfaces.SUFFIX: [("Property", "p", None, None), ("Telemetry", "t", None, None)]},)], f"m map<string,array<{interfaces.CONTENT}>>")
    assert blocks.select(interfaces.schema_spec(F.col("m"))).first()[0] == {"b": ["p"]}
