"""The machine's logits by their definition, what its factors add on held-out rows, and columns that clash."""

import zlib

import numpy as np
import pytest

from weftline.llm import toxicity


def defined(m, terms):
    x = [int(t) for t in terms if m.known[t]]
    pairs = sum(float(np.dot(m.v[a].astype(float), m.v[b].astype(float))) for i, a in enumerate(x) for b in x[i + 1 :])
    return m.bias + sum(float(m.w[t]) for t in x) + pairs


def test_logits_equal_their_definition():
    rng = np.random.default_rng(0)
    terms = [np.unique(rng.integers(0, 60, rng.integers(0, 12))) for _ in range(400)]
    y = np.array([float(3 in t and 5 in t or 9 in t) for t in terms])
    m = toxicity.fit(terms, y, epochs=5, pair_epochs=5)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(int)
    got = m.logits(np.concatenate(terms), starts)
    assert got == pytest.approx([defined(m, t) for t in terms], abs=1e-4)
    back = toxicity.FactorizationMachine.of(*m.parts())
    assert back.logits(np.concatenate(terms), starts) == pytest.approx(got, abs=1e-6)


def test_no_term_is_left_out_for_telling_nothing():
    """Every term in at least 3 documents has a weight and factors."""
    terms = [np.array([1, 2 + i % 5, 20 + i]) for i in range(100)]
    m = toxicity.fit(terms, np.array([float(i % 2) for i in range(100)]), epochs=3)
    assert np.flatnonzero(m.known).tolist() == [1, 2, 3, 4, 5, 6]


def test_factors_find_more_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    some = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter(toxicity.held_out())
    found = []
    for _ in range(2):
        rows = toxicity.score(some, m, ["doc_id", "toxic"]).collect()
        assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
        hits = [r.toxic for r in rows if r.score >= toxicity.THRESHOLD]
        found.append((sum(hits) / len(hits), sum(hits) / sum(r.toxic for r in rows)))
        m.v = np.zeros_like(m.v)
    (precision, recall), (_, without) = found
    assert precision >= 0.94 and recall >= 0.917 and recall > without + 0.03


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(i, t, 0.5, True, "t") for i, t in ((1, "a b"), (2, None), (2, None), (None, ""))], "doc_id long, text string, score double, held_out boolean, t string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    m = toxicity.train(docs, labels)
    kept = toxicity.score(docs, m, ["score", "t", "text", "held_out"])
    assert kept.columns == ["t", "text", "held_out", "score"] and [r.text for r in kept.orderBy("text").collect()] == [None, None, "", "a b"]
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD) for r in rows)
