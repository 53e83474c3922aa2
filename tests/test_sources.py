"""Numbered lines in splits against whole files, and token streams."""

import json
import random
import time

import pytest

from weftline.sources import readers
from weftline.sources.tokens import TokenStream


def numbered(data: bytes):
    lines = data.decode().replace("\r\n", "\n").replace("\r", "\n").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    some = [(i, x) for i, x in enumerate(lines) if x.strip()]
    return [(i, i + 1, x) for i, x in enumerate(lines)], [(n, i + 1, x) for n, (i, x) in enumerate(some)]


R = random.Random(8)
FILES = {
    "plain.txt": "\n".join(f"line {i}" for i in range(900)).encode(),
    "crlf.txt": "".join(R.choice(["é\U0001f600x" * R.randint(0, 9), "", "   ", "\t", "word"]) + R.choice(["\n", "\r\n"]) for _ in range(700)).encode(),
    "ends.txt": b"a\n\n  \nb\n\n\n",
    "open.txt": "ü".encode() * 400,
    "none.txt": b"",
}


@pytest.mark.parametrize("split", [61, 4096])
def test_lines_of_splits_equal_whole_files(spark, tmp_path, split):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        for blank in (True, False):
            df = readers.lines(spark, str(tmp_path), blank)
            if split == 61:
                assert df.rdd.getNumPartitions() > 100
            got = {}
            for r in df.collect():
                got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.row_idx, r.line_no, r.value))
            assert {k: sorted(v) for k, v in got.items()} == {k: w for k, v in FILES.items() if (w := numbered(v)[not blank])}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("split", [61, 4096])
def test_sections_of_splits_equal_whole_files(spark, tmp_path, split):
    want = []
    for name in ("a.txt", "b.txt", "c.txt"):
        rows = R.choices(["== {} ==", "", "  ", "x", "a longer line, longer than others, as long as a split of 61 bytes"], [1, 4, 4, 20, 2], k=600)
        rows = [x.format(i) for i, x in enumerate(rows)] if name != "c.txt" else ["no heading"] * 90
        (tmp_path / name).write_text("\n".join(rows) + "\n")
        section, n, some = None, 0, 0
        for x in rows:
            if x.startswith("=="):
                section, n, some = x[3:-3], 0, 0
                continue
            n += 1
            want.append((name, section, n, n - 1, some if x.strip() else None, x))
            some += bool(x.strip())
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        for blank in (True, False):
            got = [(r.path.rsplit("/", 1)[-1], r.section, r.line_no, r.row_idx, r.value) for r in readers.lines(spark, str(tmp_path), blank, "^== (.+) ==$").collect()]
            assert sorted(got, key=str) == sorted(((f, s, n, i if blank else j, x) for f, s, n, i, j, x in want if blank or j is not None), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbered_lines_need_no_file_for_each_customer(spark, tmp_path, monkeypatch):
    from weftline.plans import stream_queries

    monkeypatch.setattr(stream_queries, "_place", lambda spark, name: str(tmp_path / name))
    spark.range(600).selectExpr("id AS o_orderkey", "id div 3 AS o_custkey", "'5-LOW' AS o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    assert stream_queries.numbered_lines(spark, str(tmp_path)).count() == sum(i % 7 > 1 for i in range(600))
    assert len(list((tmp_path / "lines").rglob("part-*.txt"))) <= 8


def test_strict_names_the_physical_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{bad\n')
    with pytest.raises(Exception, match="bad JSON in line 3 of"):
        readers.jsonl_strict(spark, str(tmp_path)).collect()


RUNS = json.dumps([{"run_id": "a", "request": "Hel lo wörld", "step": 2}, {"run_id": "b", "request": " ".join(map(str, range(25)))}])
STUB = "weftline.sources.providers:stub_lines"


def test_token_source_batch_and_stream(spark, tmp_path):
    """The provider named first can't be had, so the second answers."""
    spark.dataSource.register(TokenStream)
    options = {"runs": RUNS, "provider": "weftline.sources.providers:not_there", "fallback": STUB, "lines_a_trigger": "10"}
    batch = sorted(map(tuple, spark.read.format("token_stream").options(**options).load().collect()))
    assert ["".join(r[4] or "" for r in batch if r[0] == x) for x in "ab"] == ["Hellowörld", "".join(map(str, range(25)))]
    assert [r[2:4] for r in batch if r[0] == "a"] == [("assistant_chunk", 2)] * 3 + [("step_status", 2)]
    got = []

    def run(enough):
        q = spark.readStream.format("token_stream").options(**options).load().writeStream.foreachBatch(lambda df, i: got.append((i, list(map(tuple, df.collect()))))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        end = time.time() + 90
        while not enough() and time.time() < end and q.isActive:
            time.sleep(0.1)
        q.stop()

    # the restart goes on behind the lines that the first run has read; a batch that was cut off comes again as it was
    run(lambda: got)
    assert 0 < sum(len(rows) for _, rows in got) < len(batch)
    run(lambda: sum(len(rows) for rows in dict(got).values()) >= len(batch))
    assert sorted(r for rows in dict(got).values() for r in rows) == batch
    assert all(rows == dict(got)[i] for i, rows in got)


def test_token_source_without_an_answer(spark):
    spark.dataSource.register(TokenStream)
    with pytest.raises(Exception, match="not_there"):
        spark.read.format("token_stream").options(runs=RUNS, provider="weftline.sources.providers:not_there").load().collect()
