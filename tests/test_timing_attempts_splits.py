"""Percentiles by selection, running figures in parts, attempts with an early end, and splits of exact sizes."""

import hashlib
import math
import random

import numpy as np
import pytest

from weftline.operators import attempts, splits, timing


@pytest.mark.parametrize("bins", [2, 4096])
def test_percentiles_equal_sorting(spark, monkeypatch, bins):
    monkeypatch.setattr(timing, "BINS", bins)
    r = random.Random(bins)
    groups = {"a": [r.gauss(0, 1) for _ in range(700)], "b": [r.choice([1.0, 2.0, 2.5]) for _ in range(100)], "c": [-1.5e308, 1.5e308, 0.0, 5e-324, 1e-300], "d": [3.25], None: [float(i) for i in range(50)], "none": [None], "odd": [math.inf, -math.inf, 1.0, 2.0, 7.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "g string, x double")
    got = {x.g: x for x in timing.time_stats(df, "x", "g").collect()}
    for g, xs in groups.items():
        xs = [x for x in xs if x is not None]
        assert got[g].n == len(xs)
        for name, p in (("median", 0.5), ("p95", 0.95)):
            if not xs:
                assert got[g][name] is None
            elif g != "odd":
                s, at = sorted(xs), (len(xs) - 1) * p
                low, high = math.floor(at), math.ceil(at)
                assert got[g][name] == pytest.approx(s[low] if low == high else (high - at) * s[low] + (at - low) * s[high], rel=1e-12)
    assert got["odd"].median == 2.0
    (all_,) = timing.time_stats(df.filter("g = 'a'"), "x").collect()
    assert all_.p95 == pytest.approx(np.percentile(groups["a"], 95)) and all_.n == 700
    assert spark.createDataFrame([(got["a"].median,)], "m double").first().m == df.filter("g = 'a'").selectExpr("percentile(x, 0.5) m").first().m
    assert timing.time_stats(df.limit(0), "x", "g").collect() == []


def test_running_stats_of_a_hot_run_in_many_parts(spark):
    r = random.Random(1)
    rows = [("hot", i, r.choice([None, r.randint(1, 99)])) for i in range(2000)] + [(f"r{i % 9}", 5000 + i, i % 4 or None) for i in range(90)] + [(None, 7, 3), ("skipped", 9000, None), ("skipped", 9001, 4), ("new", 9100, None)]
    previous = spark.createDataFrame([("skipped", 8.0, 1, 20), ("hot", 2.0, 2, 2)], "run string, avg double, min long, max long")
    out = timing.running_stats(spark.createDataFrame(r.sample(rows, len(rows)), "run string, i long, ms long"), "run", "i", "ms", previous=previous)
    was = {"skipped": (8.0, 1, 20), "hot": (2.0, 2, 2)}
    want, runs = {}, {}
    for run, i, ms in sorted(rows, key=lambda x: x[1]):
        runs.setdefault(run, []).append(ms)
    seen = {}
    for run, i, ms in sorted(rows, key=lambda x: x[1]):
        s = seen.setdefault(run, [])
        s.append(ms)
        some = [x for x in s if x is not None]
        avg, low, high = (sum(some) / len(some), min(some), max(some)) if some else was.get(run, (None, None, None))
        want[run, i] = (len(s), avg, low, high, (avg or 0) * (len(runs[run]) - len(s)))
    got = {(x.run, x.i): (x.done, x.running_avg, x.running_min, x.running_max, x.eta) for x in out.collect()}
    assert {k: v[:1] + v[2:4] for k, v in got.items()} == {k: v[:1] + v[2:4] for k, v in want.items()}
    assert all(a == pytest.approx(b) for k in want for a, b in zip((got[k][1], got[k][4]), (want[k][1], want[k][4]), strict=True) if b is not None)
    assert out.select("run", "i").distinct().count() == len(rows)


def test_attempts_end_early(spark):
    """Each query is asked again only until an attempt is good, five times at most; the result is that of all attempts."""
    from weftline.operators.scoring import best_attempt

    scores = {1: [0.9, 1, 1, 1, 1], 2: [0.2, 0.85, 0.9, 1, 1], 3: [0.5, 0.8, 0.8, 0.1, 0.2], 4: [None] * 5, 5: [None, 0.3, None, 0.3, 0.81], 6: [0.1] * 5}
    calls = spark.sparkContext.accumulator(0)
    table = spark.createDataFrame([(q, i + 1, f if f is None else float(f)) for q, fs in scores.items() for i, f in enumerate(fs)], "query_id long, round int, f1 double")

    def ask(open_, i):
        def count(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return open_.mapInArrow(count, "query_id long").join(table.filter(f"round = {i}").drop("round"), "query_id")

    best, made = attempts.attempt_until_good(spark.createDataFrame([(q,) for q in scores] + [(1,)], "query_id long"), ask)
    got = {r.query_id: (r.attempt, r.path) for r in best.collect()}
    assert got == {1: (1, "composed"), 2: (2, "composed"), 3: (2, "composed"), 4: (None, "direct"), 5: (5, "composed"), 6: (1, "composed")}
    assert calls.value == 1 + 2 + 5 * 4 == made.count()
    everything = best_attempt(table.withColumnRenamed("round", "attempt"))
    assert {r.query_id: (r.attempt, r.path) for r in everything.collect()} == got
    best, made = attempts.attempt_until_good(spark.createDataFrame([], "query_id long"), ask)
    assert best.collect() == [] == made.collect()


@pytest.mark.parametrize("n,held,test", [(5000, 0.2, 0.5), (7, 0.2, 0.5), (1, 0.2, 0.5), (333, 0.3, 1.0), (40, 0.0, 0.5), (40, 1.0, 0.25)])
def test_splits_have_exact_sizes_and_are_nested(spark, n, held, test):
    keys = [f"k{i}" for i in range(n - 1)] + [None]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys + keys[:5])], "key string, i long")
    rows = splits.split_exact(df, "key", held, test, 3).collect()
    n_eval, n_test = math.ceil(round(held * n, 9)), math.ceil(round(test * math.ceil(round(held * n, 9)), 9))
    order = sorted(keys, key=lambda k: hashlib.md5(f"3:{k or ''}".encode()).hexdigest())
    assert len(rows) == n + len(keys[:5])
    assert {r.key for r in rows if r.part == "eval"} == set(order[:n_eval]) and {r.key for r in rows if r.in_test} == set(order[:n_test])


def test_split_of_nothing(spark):
    assert splits.split_exact(spark.createDataFrame([], "key string"), "key").collect() == []
