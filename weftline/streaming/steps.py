"""Stateful step folding: one state per run, which every chunk is appended to once and read from once, when its step closes.

A step closes with its own closing status, or with its run: a step-less done or fatal event ends a run, and so does silence.
What comes after that is set apart. close_steps() is the same fold over a finished table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "run_id string, step int, kind string, text string, chunks int, state string, output string"
#: Statuses that close a step. A stopped step is recorded as an error.
CLOSING = ("done", "finished", "stopped", "error")
FINAL_TEXT, FINISHED, STOPPED = "Finished", "✅ Finished", "[Stopped]"
#: Milliseconds after which a run without events counts as ended, and for which an ended run is remembered.
SILENCE_MS, REMEMBER_MS = 600_000, 3_600_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outcome(text: str, status: str | None, output: str | None, ending: str | None, message: str | None) -> tuple[str, str | None]:
    """State and output of a closed step. Without a status of its own it is what ended its run that tells: an error for fatal and silence, else as it was."""
    if text == FINAL_TEXT:
        return "finished", FINISHED
    if status == "stopped":
        return "error", STOPPED if output is None else output
    if status is None and ending in ("fatal", "silent"):
        return "error", message if output is None else output
    return status or "running", output


class Steps(StatefulProcessor):
    """Of each run: chunks (appended to), what its open steps have got besides, and where it ended."""

    def __init__(self, silence_ms: int, remember_ms: int) -> None:
        self.silence_ms, self.remember_ms = silence_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "step int, seq bigint, chunk string")
        self.steps = handle.getMapState("steps", "step int", "output string, closed boolean")
        self.ended = handle.getValueState("ended", "how string")

    def _remind(self, at_ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def _close(self, run: str, steps: dict, new: list, which: int | None, status: str | None, ending: str | None, message: str | None, rows: list) -> list:
        """Rows for step which, or for all open ones; returns the chunks that stay open. All chunks of the run's open steps are read, and no others are left by then."""
        held = [*self.chunks.get(), *new] if self.chunks.exists() else list(new)
        open_ = sorted({s for s, (_, closed) in steps.items() if not closed} if which is None else {which})
        for step in open_:
            parts = {seq: chunk for s, seq, chunk in held if s == step}
            text = "".join(parts[seq] for seq in sorted(parts)).strip()
            state, output = outcome(text, status, steps.get(step, (None, False))[0], ending, message)
            rows.append((run, step, "step", text, len(parts), state, output))
            steps[step] = (None, True)
            self.steps.updateValue((step,), (None, True))
        left = [] if which is None else [x for x in held if x[0] != which]
        if self.chunks.exists():
            self.chunks.clear()
        return [tuple(x) for x in left]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, out = key[0], []
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        ended = self.ended.get()[0] if self.ended.exists() else None
        steps = {k[0]: (v[0], v[1]) for k, v in self.steps.iterator()} if ended is None else {}
        new: list = []
        for e in events.itertuples():
            step = None if pd.isna(e.step) else int(e.step)
            late = ended is not None or (step is not None and steps.get(step, (None, False))[1])
            if late:
                if step is not None and e.type == "assistant_chunk" and isinstance(e.chunk, str):
                    out.append((run, step, "late", e.chunk, 1, None, None))
            elif e.type in ("done", "fatal"):
                new = self._close(run, steps, new, None, None, e.type, e.message if isinstance(e.message, str) else None, out)
                ended = e.type
            elif step is not None:
                known = steps.get(step)
                output = e.output if e.type == "exec_output" and isinstance(e.output, str) else known[0] if known else None
                if known is None or output != known[0]:
                    steps[step] = (output, False)
                    self.steps.updateValue((step,), (output, False))
                if e.type == "assistant_chunk" and isinstance(e.chunk, str):
                    new.append((step, int(e.seq), e.chunk))
                elif e.type == "step_status" and e.status in CLOSING:
                    new = self._close(run, steps, new, step, e.status, None, None, out)
        now = timerValues.getCurrentProcessingTimeInMs()
        if ended is None:
            if new:
                self.chunks.appendList(new)
            self._remind(now + self.silence_ms)
        else:
            self._forget(ended)
            self._remind(now + self.remember_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def _forget(self, ended: str | None) -> None:
        for state in (self.chunks, self.steps):
            if state.exists():
                state.clear()
        if ended is None:
            self.ended.clear()
        else:
            self.ended.update((ended,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list = []
        if self.ended.exists():
            self._forget(None)
        else:
            steps = {k[0]: (v[0], v[1]) for k, v in self.steps.iterator()}
            self._close(key[0], steps, [], None, None, "silent", None, out)
            self._forget("silent")
            self._remind(timerValues.getCurrentProcessingTimeInMs() + self.remember_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> None:
    """The state store that list and map state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def stream_steps(events: DataFrame, silence_ms: int = SILENCE_MS, remember_ms: int = REMEMBER_MS) -> DataFrame:
    """events (a stream as event_source gives it): a row of kind step when a step closes, and of kind late for each chunk that came after its step or run had ended.

    Events of a run are taken by seq within a trigger, a repeated seq once. An ended run keeps one word of state for
    remember_ms, to know what is late, and nothing after that; chunks that come later still begin the run anew. The same
    word keeps runs that fall silent.
    """
    stateful(events.sparkSession)
    return events.filter("run_id is not null").groupBy("run_id").transformWithStateInPandas(Steps(silence_ms, remember_ms), OUT, "Append", "ProcessingTime")


def close_steps(events: DataFrame) -> DataFrame:
    """What stream_steps gives for whole runs, from a table of events. Steps of a run without an end that have no closing status are not closed: no row.

    A run ends with its first done or fatal by seq, a step with its first closing status or its run; chunks by seq
    beyond that are late.
    """
    closing = (F.col("type") == "step_status") & F.col("status").isin(*CLOSING)
    ending = F.col("type").isin("done", "fatal")
    e = events.filter("run_id is not null").dropDuplicates(["run_id", "seq"])
    ends = e.filter(ending).groupBy("run_id").agg(F.min(F.struct("seq", "type", "message")).alias("end"))
    e = e.filter(F.col("step").isNotNull()).join(ends, "run_id", "left")
    e = e.withColumn("own", F.min(F.when(closing, F.struct("seq", "status"))).over(Window.partitionBy("run_id", "step")))
    end = F.least("own.seq", "end.seq")
    e = e.withColumn("in", F.col("seq") <= F.coalesce(end, F.col("seq")))
    chunk = (F.col("type") == "assistant_chunk") & F.col("chunk").isNotNull()
    late = e.filter(chunk & ~F.col("in")).select("run_id", "step", F.lit("late").alias("kind"), F.col("chunk").alias("text"), F.lit(1).alias("chunks"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("output"))
    closed = e.filter(end.isNotNull() & F.col("in")).groupBy("run_id", "step").agg(
        F.array_sort(F.collect_list(F.when(chunk, F.struct("seq", "chunk")))).alias("c"), F.first("end").alias("end"), F.first(F.when(F.col("own.seq") == end, F.col("own.status")), ignorenulls=True).alias("status"),
        F.max_by("output", F.when((F.col("type") == "exec_output") & F.col("output").isNotNull(), F.col("seq"))).alias("said"),
    )
    text = _strip(F.array_join(F.transform("c", lambda x: x["chunk"]), ""))
    fatal = F.col("status").isNull() & (F.col("end.type") == "fatal")
    state = F.when(text == FINAL_TEXT, "finished").when(F.col("status") == "stopped", "error").when(fatal, "error").otherwise(F.coalesce("status", F.lit("running")))
    output = F.when(text == FINAL_TEXT, FINISHED).when(F.col("status") == "stopped", F.coalesce("said", F.lit(STOPPED))).when(fatal, F.coalesce("said", F.col("end.message"))).otherwise(F.col("said"))
    return closed.select("run_id", "step", F.lit("step").alias("kind"), text.alias("text"), F.size("c").alias("chunks"), state.alias("state"), output.alias("output")).unionByName(late)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


class Frames(StatefulProcessor):
    """Server-sent events of each run: a meta frame, one for each event, a ping after each silent poll_ms, and no more after the end."""

    def __init__(self, poll_ms: int, remember_ms: int) -> None:
        self.poll_ms, self.remember_ms = poll_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next bigint, ended boolean")

    def _write(self, key, frames: list[str], ended: bool, now: int) -> Iterator[pd.DataFrame]:
        at = self.place.get()[0] if self.place.exists() else 0
        self.place.update((at + len(frames), ended))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + (self.remember_ms if ended else self.poll_ms))
        yield pd.DataFrame({"run_id": [key[0]] * len(frames), "place": range(at, at + len(frames)), "frame": frames})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        begun, ended = self.place.exists(), self.place.exists() and bool(self.place.get()[1])
        frames = [] if begun else [META]
        for kind, frame in zip(events["type"], events["frame"], strict=True):
            if not ended and isinstance(frame, str):
                frames.append(frame)
                ended = kind in ("done", "fatal")
        yield from self._write(key, frames, ended, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.place.get()[1]:
            self.place.clear()
            yield pd.DataFrame({"run_id": [], "place": [], "frame": []}).astype({"run_id": str, "place": "int64", "frame": str})
        else:
            yield from self._write(key, [PING], False, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


# Frames of the protocol that hold no event.
META, PING = "event: meta\ndata: {}\n\n", ": ping\n\n"


def frame() -> Column:
    """The frame of an event by its type: named event and data lines and a blank line; a fatal event is called error. Null for types that have none."""
    kind = F.col("type")
    one = lambda name, *fields: F.concat(F.lit(f"event: {name}\ndata: "), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}) if fields else F.lit("{}"), F.lit("\n\n"))
    said = F.coalesce("message", F.lit("Unknown error")).alias("message")
    return F.when(kind == "assistant_chunk", one("assistant_chunk", "step", "chunk")).when(kind == "exec_output", one("exec_output", "step", "output")).when(kind == "step_status", one("step_status", "step", "status")).when(kind == "fatal", one("error", said)).when(kind == "done", one("done"))


def sse_frames(events: DataFrame) -> DataFrame:
    """run_id, place and frame: the frames of whole runs from a table of events, up to the first fatal or done."""
    e = events.filter("run_id is not null").withColumn("frame", frame()).filter("frame is not null")
    end = F.min(F.when(F.col("type").isin("fatal", "done"), F.col("seq"))).over(Window.partitionBy("run_id"))
    e = e.withColumn("end", end).filter("end is null or seq <= end").dropDuplicates(["run_id", "seq"])
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("seq")).cast("long")
    return e.select("run_id", place.alias("place"), "frame").unionByName(e.select("run_id").distinct().select("run_id", F.lit(0).cast("long").alias("place"), F.lit(META).alias("frame")))


def sse_stream(events: DataFrame, poll_ms: int = 500, remember_ms: int = REMEMBER_MS) -> DataFrame:
    """run_id, place and frame of a stream of events, with a ping for each run that has had none for poll_ms."""
    stateful(events.sparkSession)
    e = events.filter("run_id is not null").select("run_id", "seq", "type", frame().alias("frame"))
    return e.groupBy("run_id").transformWithStateInPandas(Frames(poll_ms, remember_ms), "run_id string, place bigint, frame string", "Append", "ProcessingTime")
