"""The plan from a histogram: every piece placed once, near the bound at any count, and mostly by patterns of the program."""

import random
from collections import Counter

import pytest

from weftline.llm import packing


def planned(counts, capacity, monkeypatch):
    left = []
    fit = packing._best_fit
    monkeypatch.setattr(packing, "_best_fit", lambda n, k, c: left.append(int(k.sum())) or fit(n, k, c))
    out = packing.pack_histogram(counts, capacity)
    held = Counter()
    for times, pattern in out:
        assert times > 0 and sum(n * k for n, k in pattern.items()) <= capacity
        for n, k in pattern.items():
            held[n] += times * k
    assert held == Counter({n: k for n, k in counts.items() if k})
    return sum(t for t, _ in out), left[0]


def spread(pieces, seed=1):
    r = random.Random(seed)
    return Counter(min(2047, 2 + int(r.lognormvariate(5.2, 1.1))) for _ in range(pieces))


@pytest.mark.parametrize("times", [1, 10, 1000])
def test_patterns_place_most_pieces_near_the_bound(monkeypatch, times):
    counts = {n: k * times for n, k in spread(6000).items()}
    sequences, rest = planned(counts, 2048, monkeypatch)
    bound = -(-sum(n * k for n, k in counts.items()) // 2048)
    assert sequences <= bound * 1.002 + 1 and rest < 0.2 * sum(counts.values())


@pytest.mark.parametrize("counts", [{}, {2048: 7}, {700: 900, 710: 80, 760: 33}, {1500: 40, 5: 3}, {1: 10_000}, {1025: 99, 1023: 98, 1024: 1}])
def test_odd_histograms(monkeypatch, counts):
    sequences, _ = planned(counts, 2048, monkeypatch) if counts else (0, 0)
    best = {(): 0, (2048,): 7, (700, 710, 760): 507, (5, 1500): 40, (1,): 5, (1023, 1024, 1025): 100}[tuple(sorted(counts))]
    assert best <= sequences <= best * 1.05 + 2
    assert packing.pack_histogram({}, 2048) == []


def test_columns_of_the_caller_stay(spark):
    rows = [(i, 0, 1 + i % 9, i, f"b{i}", i * 2, i * 3, i * 5) for i in range(100)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long, bucket string, before long, rank long, n long"), 10).collect()
    assert sorted((r.doc_id, r.bucket, r.before, r["rank"], r.n) for r in out) == [(i, f"b{i}", i * 2, i * 3, i * 5) for i in range(100)]
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(ps)[:i]) for ps in by.values() for i, (o, _) in enumerate(sorted(ps)))
