"""Operators 11 to 13 against brute force, on edge cases and on trees and blocks far smaller than the registered ones."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm import divergence, fingerprints, queries, ranking

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, block int, value long"


def docs_of(spark, rows):
    """rows: doc_id, text, lang, source; with columns beside that clash with names used inside."""
    return spark.createDataFrame([(*r, 7, "x", 3, 9) for r in rows], DOCS)


def random_docs(seed, n, words=40, vocabulary=60):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abçdéß", k=r.randint(1, 4))) for _ in range(vocabulary)] + ["A", "a9", "Zz", "1"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    return [(i, r.choice([" ", "-", ".\n"]).join(r.choices(vocab, weights, k=r.randint(0, words))), r.choice(["en", "de", None]), r.choice(["s", "s", "s", "t", "ü", None])) for i in range(n)]


EDGE = [(900, None, "en", "s"), (901, "", "en", "s"), (902, " 12 -- ", "fr", "only"), (903, "a b " * 30_000, "en", "t"), (904, "a b c", None, None), (904, "a b c", None, None), (None, "zz a9", "de", "new"), (905, "x", "", "")]

# 11 source divergence


def audit(rows, least, k):
    rows = [(t or "", lang or "", source or "") for _, t, lang, source in rows]
    words = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t, lang, source in rows]
    out = []
    for lang in {x[1] for x in rows}:
        df = Counter(w for a, _, ws in words if a == lang for w in set(ws))
        kept = {w for w, n in df.items() if n >= least}
        by = {}
        for a, s, ws in words:
            if a == lang:
                by.setdefault(s, Counter()).update(w for w in ws if w in kept)
        everyone = sum(by.values(), Counter())
        share = lambda c, kept=kept: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in by.items()}, share(everyone)
        for s in by:
            pair = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in by if o != s]
            term = [(q[w] - p[s][w], w.encode()) for w in kept if by[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:k])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("least,k", [(1, 3), (3, 1000), (30, 2)])
def test_audit_equals_brute_force(spark, least, k):
    rows = random_docs(least, 150) + EDGE
    got = divergence.audit_sources(docs_of(spark, rows), least, k)
    assert sorted(map(tuple, got.collect())) == audit(rows, least, k)


def test_audit_in_tiles(spark):
    """More sources than one side of a tile holds."""
    rows = [(i, " ".join(random.Random(i).choices(["a", "b", "c", "d", "e"], k=4)), "en", f"s{i % (divergence.TILE + 3)}") for i in range(2 * divergence.TILE)]
    got = divergence.audit_sources(docs_of(spark, rows), 1, 2)
    assert sorted(map(tuple, got.collect())) == audit(rows, 1, 2)


def test_audit_of_nothing(spark):
    assert divergence.audit_sources(docs_of(spark, [])).collect() == []


# 12 ranked search


def ranked(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(w), len(w)) for i, w in ((d[0], terms(d[1])) for d in docs) if w]
    n, every = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in held:
            m = 75 + 25 * size * n // every
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [16_384, 60, 7])
def test_ranking_equals_brute_force(spark, monkeypatch, shard):
    docs = random_docs(shard, 300) + EDGE + [(400 + i, "a b çç same", "en", "s") for i in range(50)]
    items = [(1, "a b c d"), (2, "a a a A9 zz"), (3, None), (4, ""), (5, "nothing-here"), (6, "çç SAME same"), (7, " ".join(f"a{i} b{i}" for i in range(3000)) + " zz 1"), (None, "a")]
    items += [(10 + i, d[1]) for i, d in enumerate(docs[:40]) if d[1]]
    # the driver deals the documents out in so many tasks, each with trees of its own
    monkeypatch.setattr(ranking, "SHARD_DOCS", shard)
    frame = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = ranking.rank_documents(docs_of(spark, docs), frame, 6)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 6)


def test_ranking_in_blocks_of_items(spark, monkeypatch):
    docs, items = random_docs(5, 80), [(i, f"a b{i} çç") for i in range(30)]
    monkeypatch.setattr(ranking, "ITEM_BYTES", 90)
    got = ranking.rank_documents(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 3)


def test_ranking_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranking.rank_documents(docs_of(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []
    assert ranking.rank_documents(docs_of(spark, EDGE), none).collect() == []


def test_trees_are_heaps_in_order_and_prune():
    rng = np.random.default_rng(3)
    docs, n = 4000, 30_000
    pairs = np.unique(rng.integers(0, 40 * docs, n))
    term, doc = pairs // docs, pairs % docs
    impact = rng.zipf(1.6, len(pairs)).clip(1, 10**6)
    trees = ranking.Treaps(term, doc, impact, docs)
    for child, side in ((trees.left, -1), (trees.right, 1)):
        at = np.flatnonzero(child[:-1] >= 0)
        assert (trees.impact[child[at]] <= trees.impact[at]).all() and (np.sign(trees.doc[child[at]] - trees.doc[at]) == side).all()
    best = ranking.Best(1, 10)
    scored = ranking.search(trees, np.arange(docs), np.array([0]), np.arange(5)[None, :], np.ones((1, 5), np.int64), best)
    total = np.bincount(doc[term < 5], impact[term < 5], docs).astype(np.int64)
    order = np.lexsort((np.arange(docs), -total))[:10]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == total[order].tolist()
    assert scored < np.count_nonzero(total) / 4
    # equal impacts don't make a list of a tree
    flat = ranking.Treaps(np.zeros(4000, np.int64), np.arange(4000), np.ones(4000, np.int64), 4000)
    depth, level = 0, [int(flat.root[0])]
    while level:
        depth, level = depth + 1, [c for x in level for c in (int(flat.left[x]), int(flat.right[x])) if c >= 0]
    assert depth < 60


# 13 fingerprints


def printed(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        k = len(t) // 3
        new = t[: len(t) - k] + u[:k]
        a, b, c = (fingerprints.sketch(x.encode()) for x in (t, new, u))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a.written(), b.written(), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("block_rows", [4096, 40, 7])
def test_fingerprints_equal_brute_force(spark, block_rows):
    rows = random_docs(1, 200, 300) + [r for r in EDGE if r[0] != 904] + [(-5, "é" * 10, "en", "s"), (3000, "long \U0001f600 " * 40_000, "en", "s")]
    got = fingerprints.fingerprint_documents(docs_of(spark, rows), block_rows=block_rows).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == printed([r[:2] for r in rows])


def test_fingerprints_of_a_hot_id_and_repeated_rows(spark):
    """Every row has one follower, each text but for the order among equal ids that the docstring leaves to a hash."""
    rows = [(5, f"text {i} " * 9, "en", "s") for i in range(120)] + [(i, f"other {i}", "en", "s") for i in range(60)] + [(7, "same", "en", "s")] * 30 + [(None, "none", "en", "s")] * 4
    one, many = (sorted(map(tuple, fingerprints.fingerprint_documents(docs_of(spark, rows), block_rows=b).select(COLUMNS).collect()), key=str) for b in (4096, 5))
    assert one == many and len(one) == len(rows)
    assert sum(r[0] == 5 for r in one) == 121


def test_fingerprints_of_nothing_and_of_one(spark):
    assert fingerprints.fingerprint_documents(docs_of(spark, [])).collect() == []
    (r,) = fingerprints.fingerprint_documents(docs_of(spark, [(1, "abcdef", "en", "s")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1


def test_sketches_merge_and_estimate_containment():
    r = random.Random(4)
    words = [str(r.random()) for _ in range(40_000)]
    long, short = " ".join(words), " ".join(words[500:2500])
    a, b = (fingerprints.sketch(x.encode()) for x in (long, short))
    assert fingerprints.containment(b, a) == 1 and 0.04 < fingerprints.containment(a, b) < 0.06
    assert abs(len(b.kept) * fingerprints.SCALE / b.shingles - 1) < 0.15
    other = fingerprints.sketch(" ".join(map(str, range(3000))).encode())
    assert fingerprints.likeness(b, other) < 0.01
    assert (fingerprints.merged(a, b) == a.kept).all()
    back = fingerprints.read_sketch(a.written())
    assert back[:2] == a[:2] and (back.kept == a.kept).all()


def test_estimates_on_a_table(spark):
    """The mean error of the likeness against the shingle sets themselves."""
    from weftline.llm.common import shingle_set

    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op13_fingerprints(spark, SF).collect()}
    errors = []
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        a, b = (set(shingle_set(x.encode(), 5).tolist()) for x in (t, fingerprints.edited(t, u)))
        if len(a) > 100:
            errors.append(abs(got[i].near_edited - len(a & b) / len(a | b)))
    assert len(errors) > 50 and np.mean(errors) < 0.05
