"""A data source of token streams: newline-delimited JSON chunks of an answer as events, in batch and as a stream that resumes where it was.

spark.dataSource.register(TokenStream), then spark.read or spark.readStream with format("token_stream") and the options
runs (a JSON list of objects with run_id, request and, if not 0, step), provider and, if wanted, fallback ("module:function",
called with a request and a number of lines to leave out, for the lines of its answer), and for streams lines_a_trigger.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "run_id string, seq bigint, type string, step int, chunk string, status string"


def _function(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class Answer:
    """The lines of one run's answer. Their numbers are the events' seq, so what is read again is the same."""

    def __init__(self, run: dict, options: dict) -> None:
        self.run, self.step = run, int(run.get("step", 0))
        self.providers = [options[k] for k in ("provider", "fallback") if options.get(k)]

    def lines(self, skip: int) -> Iterator[bytes | str]:
        """Lines from number skip on, of the first provider that gives its first line without an error."""
        for i, name in enumerate(self.providers):
            try:
                lines = iter(_function(name)(self.run["request"], skip))
                first = next(lines, None)
            except Exception:  # noqa: BLE001  a remote source: what fails is asked of the next one
                if i + 1 == len(self.providers):
                    raise
                continue
            if first is not None:
                yield first
                yield from lines
            return

    def events(self, skip: int = 0, most: int | None = None) -> Iterator[tuple[tuple | None, int, bool]]:
        """(event or None, lines read so far, ended) of each line. Blank and bad lines are no events; a line that says done ends the answer, and so does its last line."""
        at = skip
        for line in self.lines(skip):
            at += 1
            event, done = None, False
            try:
                data = json.loads(line)
            except ValueError:
                data = None
            if isinstance(data, dict):
                message, done = data.get("message"), bool(data.get("done"))
                content = message.get("content") if isinstance(message, dict) else None
                if isinstance(content, str) and (content or not done):
                    event = (self.run["run_id"], 2 * at, "assistant_chunk", self.step, content, None)
            yield event, at, done
            if done or (most is not None and at - skip >= most):
                return
        yield None, at, True

    def end(self, at: int) -> tuple:
        return (self.run["run_id"], 2 * at + 1, "step_status", self.step, None, "done")


class One(InputPartition):
    def __init__(self, run: dict) -> None:
        self.run = run


class TokenReader(DataSourceReader):
    """One partition a run; each answer is read to its end in one task."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [One(r) for r in json.loads(self.options["runs"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        answer = Answer(partition.run, self.options)
        for event, at, ended in answer.events():
            if event:
                yield event
            if ended:
                yield answer.end(at)


class TokenStreamReader(SimpleDataSourceStreamReader):
    """Offsets hold for each run how many lines are read and whether it has ended; a trigger reads at most lines_a_trigger of each."""

    def __init__(self, options: dict) -> None:
        self.options, self.runs = options, json.loads(options["runs"])
        self.most = int(options.get("lines_a_trigger", 1000))

    def initialOffset(self) -> dict:
        return {r["run_id"]: [0, False] for r in self.runs}

    def _rows(self, run: dict, start: int, most: int) -> tuple[list[tuple], int, bool]:
        answer, rows, at, ended = Answer(run, self.options), [], start, False
        for event, at, ended in answer.events(start, most):
            if event:
                rows.append(event)
        return (rows + [answer.end(at)] if ended else rows), at, ended

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, end = [], dict(start)
        for run in self.runs:
            at, ended = start.get(run["run_id"], [0, False])
            if not ended:
                rows, at, ended = self._rows(run, at, self.most)
                out += rows
                end[run["run_id"]] = [at, ended]
        return iter(out), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for run in self.runs:
            (a, was), (b, ended) = start.get(run["run_id"], [0, False]), end.get(run["run_id"], [0, False])
            if not was and b > a:
                rows, _, _ = self._rows(run, a, b - a)
                yield from (r for r in rows if r[2] == "assistant_chunk")
            if ended and not was:
                yield Answer(run, self.options).end(b)

    def commit(self, end: dict) -> None:
        pass


class TokenStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_stream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TokenReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TokenStreamReader(dict(self.options))
