"""Stateful folds and the exactly-once sink against their batch forms."""

import json
import time

import pytest

from weftline.sources.exactly_once import Ledger, rows_and_keys
from weftline.streaming import fold, steps


def event(run, seq, kind, step=None, chunk=None, output=None, status=None, message=None):
    return (run, seq, kind, step, chunk, output, status, message)


def said(run, seq, step, text):
    return [event(run, seq + i, "assistant_chunk", step, c) for i, c in enumerate(text)]


#: The four endings, chunks out of order and repeated, chunks after a step's and a run's end.
RUNS = [
    *said("done", 0, 0, ["b ", " c"]), event("done", 5, "exec_output", 0, output="42"), event("done", 6, "step_status", 0, status="done"), event("done", 9, "done"),
    event("final", 0, "step_status", 0, status="running"), *reversed(said("final", 1, 0, ["Fin", "is", "hed\n"])), event("final", 2, "assistant_chunk", 0, "is"), event("final", 7, "step_status", 0, status="finished"), event("final", 8, "done"), *said("final", 20, 0, ["after"]),
    *said("stop", 0, 0, ["x"]), event("stop", 1, "step_status", 0, status="done"), *said("stop", 2, 1, ["half"]), event("stop", 4, "step_status", 1, status="stopped"), *said("stop", 5, 1, ["late"]), event("stop", 9, "done"),
    *said("fatal", 0, 0, ["a", "é"]), *said("fatal", 2, 1, ["b"]), event("fatal", 5, "fatal", message="broke"), event("fatal", 6, "done"), *said("fatal", 8, 2, ["never"]),
    event(None, 1, "done"),
]
WANT = {
    ("done", 0, "step", "b  c", 2, "done", "42"), ("final", 0, "step", "Finished", 3, "finished", "✅ Finished"), ("final", 0, "late", "after", 1, None, None), ("stop", 0, "step", "x", 1, "done", None),
    ("stop", 1, "step", "half", 1, "error", "[Stopped]"), ("stop", 1, "late", "late", 1, None, None), ("fatal", 0, "step", "aé", 2, "error", "broke"), ("fatal", 1, "step", "b", 1, "error", "broke"), ("fatal", 2, "late", "never", 1, None, None),
}


def put(spark, folder, rows):
    spark.createDataFrame(rows, fold.EVENTS).coalesce(1).write.mode("append").json(str(folder))


def until(true, seconds=90):
    end = time.time() + seconds
    while not true() and time.time() < end:
        time.sleep(0.2)
    assert true()


def test_close_steps(spark):
    rows = steps.close_steps(spark.createDataFrame(RUNS, fold.EVENTS)).collect()
    assert {tuple(r) for r in rows} == WANT and len(rows) == len(WANT)
    assert steps.close_steps(spark.createDataFrame([], fold.EVENTS)).count() == 0


@pytest.mark.parametrize("triggers", [1, 3])
def test_stream_equals_batch_and_leaves_no_state(spark, tmp_path, triggers):
    """Events come by seq, in one trigger or several; the state of ended runs is gone after remember_ms."""
    folder, got = tmp_path / "in", []
    put(spark, folder, RUNS[:0])
    stream = steps.stream_steps(fold.event_source(spark, str(folder)), remember_ms=4000 if triggers > 1 else 500)
    q = stream.writeStream.foreachBatch(lambda df, i: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        cut = max(e[1] for e in RUNS) + 1
        if triggers == 1:
            put(spark, folder, RUNS)
        else:
            for low, high in ((0, 3), (3, 7), (7, cut)):
                put(spark, folder, [e for e in RUNS if low <= e[1] < high])
                time.sleep(2.5)  # some triggers: with timers there is always another one to come
        until(lambda: len(got) >= len(WANT))
        assert set(got) == WANT and len(got) == len(WANT)
        until(lambda: q.lastProgress.stateOperators[0].numRowsTotal == 0)
    finally:
        q.stop()


def test_silence_ends_a_run(spark, tmp_path):
    folder, got = tmp_path / "in", []
    put(spark, folder, [*said("quiet", 0, 0, ["so ", "far"]), event("quiet", 3, "exec_output", 0, output="o")])
    q = steps.stream_steps(fold.event_source(spark, str(folder)), silence_ms=600, remember_ms=300_000).writeStream.foreachBatch(lambda df, i: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        until(lambda: got)
        put(spark, folder, said("quiet", 9, 0, ["late"]))
        until(lambda: len(got) > 1)
        assert got == [("quiet", 0, "step", "so far", 2, "error", "o"), ("quiet", 0, "late", "late", 1, None, None)]
    finally:
        q.stop()


def parsed(frame):
    if frame == steps.PING:
        return "ping", None
    name, data, *rest = frame.split("\n")
    assert rest == ["", ""]
    return name.removeprefix("event: "), json.loads(data.removeprefix("data: "))


def test_frames_end_and_ping(spark, tmp_path):
    folder, got = tmp_path / "in", []
    rows = [*said("f", 0, 0, ["é\n"]), event("f", 1, "exec_output", 0, output="o"), event("f", 2, "step_status", 0, status="done"), event("f", 3, "other"), event("f", 4, "fatal"), event("f", 5, "done")]
    want = [("meta", {}), ("assistant_chunk", {"step": 0, "chunk": "é\n"}), ("exec_output", {"step": 0, "output": "o"}), ("step_status", {"step": 0, "status": "done"}), ("error", {"message": "Unknown error"})]
    batch = steps.sse_frames(spark.createDataFrame([*rows, event("g", 0, "done")], fold.EVENTS)).orderBy("run_id", "place").collect()
    assert [parsed(r.frame) for r in batch if r.run_id == "f"] == want and [parsed(r.frame)[0] for r in batch if r.run_id == "g"] == ["meta", "done"]
    put(spark, folder, rows[:2])
    q = steps.sse_stream(fold.event_source(spark, str(folder)), poll_ms=300).writeStream.foreachBatch(lambda df, i: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    try:
        until(lambda: any(f == steps.PING for *_, f in got))
        put(spark, folder, rows[2:])
        until(lambda: any("event: error" in f for *_, f in got))
        frames = [parsed(f) for _, _, f in sorted(got, key=lambda r: r[1])]
        assert [f for f in frames if f[0] != "ping"] == want and frames[-1] == want[-1]
        assert [r[1] for r in sorted(got, key=lambda r: r[1])] == list(range(len(got)))
    finally:
        q.stop()


def test_a_crash_between_rows_and_keys_leaves_each_row_once(spark, tmp_path):
    """The first run dies after a batch's rows are written and before its keys are; the restart finds every row once."""
    folder, schema = tmp_path / "in", "id long, v string"
    ledger = Ledger(spark, f"file://{tmp_path}/out")
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).selectExpr("id", "concat('v', id) as v").coalesce(1).write.mode("append").json(str(folder))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))

    def run(tables):
        q = stream().writeStream.foreachBatch(ledger.sink(tables)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q

    def dies_in_the_third(df):
        # the keys of the third batch fail when they are written, after its rows
        bad = df.selectExpr("if(id >= 20, raise_error('killed'), id) as id") if len(ledger.committed()) == 2 else df.select("id")
        return {"rows": df, "keys": bad}

    with pytest.raises(Exception, match="killed"):
        run(dies_in_the_third)
    assert len(ledger.committed()) == 2 and (tmp_path / "out/rows/2").exists()
    assert ledger.read("rows", schema).count() == 20 and ledger.read("keys", "id long").count() == 20
    run(rows_and_keys("id"))
    assert sorted(map(tuple, ledger.read("rows", schema).collect())) == [(i, f"v{i}") for i in range(40)]
    assert sorted(r.id for r in ledger.read("keys", "id long").collect()) == list(range(40))
    # a batch that comes again is left out
    assert ledger.commit(0, {"rows": spark.range(5)}) is False and ledger.read("rows", schema).count() == 40


def test_an_empty_ledger(spark, tmp_path):
    assert Ledger(spark, f"file://{tmp_path}/none").read("rows", "id long").count() == 0
