"""Text generators and embedders as batch functions; a provider runs once in each Python worker. Deterministic stubs for tests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Generate = Callable[[list[str]], list[str]]


@lru_cache(None)
def cached(make: Callable):
    """The provider that make builds, once for each worker."""
    return make()


def generate(df: DataFrame, prompt: str, out: str, make: Callable[[], Generate], fallback: Callable[[], Generate] | None = None) -> DataFrame:
    """Adds out, the provider's text for column prompt. With fallback, what the first can't do goes to the second; a failure of both is null."""

    def one(texts: list[str]) -> list[str | None]:
        for m in (make, fallback):
            if m is not None:
                try:
                    return cached(m)(texts)
                except Exception:  # noqa: BLE001  providers are remote: any failure is a missing answer
                    continue
        return [None] * len(texts)

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(one(b.fillna("").tolist()))

    return df.withColumn(out, call(F.col(prompt)))


def embed(df: DataFrame, text: str, out: str, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    @F.pandas_udf("array<float>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(cached(make)(b.fillna("").tolist()))

    return df.withColumn(out, call(F.col(text)))


def stub_generator() -> Generate:
    """Answers with a fenced JSON object of the prompt's digest."""
    return lambda texts: ['```json\n{"digest": "%s", "n": %d}\n```' % (hashlib.sha256(t.encode()).hexdigest()[:8], len(t)) for t in texts]


def stub_embedder(width: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """Hashed letter trigrams, L2-normalized."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for i in range(max(1, len(t) - 2)):
                v[hashlib.md5(t[i : i + 3].encode()).digest()[0] % width] += 1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return run


def stub_lines(request: str, skip: int) -> Iterator[str]:
    """A token stream's lines: the request's words as chunks, each after a blank and a bad line, and what says that the answer is done."""
    words = request.split()
    lines = [x for w in words for x in ("", "{bad", json.dumps({"message": {"content": w}}))]
    return iter([*lines, json.dumps({"message": {"content": ""}, "done": True}), lines[-1] if lines else ""][skip:])
