"""Exact nearest neighbours against all pairs."""

import numpy as np
import pytest

from weftline.operators import neighbours

WIDTH = 12


def clustered(n, seed, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, WIDTH)) * 4
    return (c[rng.integers(0, centres, n)] + rng.normal(size=(n, WIDTH)) * 0.15).round(2)


def brute(q, ids, v, k, metric, own):
    out = {}
    for i, x in q.items():
        s = [(-(float(np.add.accumulate(x * y)[-1]) if metric == "ip" else -float(np.add.accumulate((x - y) ** 2)[-1])), int(j)) for j, y in zip(ids, v, strict=True) if own or j != i]
        out |= {(i, r + 1): (j, round(-a, 9)) for r, (a, j) in enumerate(sorted(s)[:k])}
    return out


@pytest.mark.parametrize("metric,own,k,block", [("ip", True, 3, 64), ("l2", False, 5, 32), ("ip", False, 1, 8192), ("l2", True, 400, 50)])
def test_nearest_equals_all_pairs(spark, monkeypatch, metric, own, k, block):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", block)
    v = clustered(300, k)
    v[200:230] = v[10]  # ties, of which the smaller ids count
    v[5] = 0
    ids = np.random.default_rng(1).permutation(10_000)[:300]
    frame = spark.createDataFrame([(int(i), x.tolist(), "x") for i, x in zip(ids, v, strict=True)] + [(77_777, None, "x"), (None, v[0].tolist(), "x"), (77_778, [1.0], "x"), (77_779, [None] * WIDTH, "x")], "vec_id long, embedding array<double>, ring string")
    q = {int(ids[i]): v[i] for i in (0, 5, 10, 200, 299)}
    queries = spark.createDataFrame([(i, x.tolist(), 1) for i, x in q.items()] + [(-1, None, 1)], "query_id long, query_embedding array<double>, cut int")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in neighbours.nearest(queries, frame, k, metric, own).collect()}
    assert got == brute(q, ids, v, k, metric, own)


def test_clustered_vectors_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 200)
    for metric in ("ip", "l2"):
        v = clustered(4000, 9, 40)
        if metric == "ip":
            v = v / np.linalg.norm(v, axis=1)[:, None]
        frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        queries = frame.filter("vec_id % 40 = 0").selectExpr("vec_id as query_id", "embedding as query_embedding")
        scored = spark.sparkContext.accumulator(0)
        got = {(r.query_id, r["rank"]): r.vec_id for r in neighbours.nearest(queries, frame, 5, metric, scored=scored).collect()}
        assert got == {key: j for key, (j, _) in brute({i: v[i] for i in range(0, 4000, 40)}, range(4000), v, 5, metric, True).items()}
        assert 0 < scored.value < 0.5 * 100 * 4000


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    ask = lambda d: d.selectExpr("vec_id as query_id", "embedding as query_embedding")
    assert neighbours.nearest(ask(some), none).collect() == [] == neighbours.nearest(ask(none), some).collect()
    assert [(r.vec_id, r.score) for r in neighbours.nearest(ask(some), some, 4).collect()] == [(1, 5.0)] and neighbours.nearest(ask(some), some, own=False).collect() == []
