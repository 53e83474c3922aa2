"""Source divergence audit: in which terms a source of a language stands out, and how far any two sources are apart.

The terms that stand out most are found by an upper-bound search: a group's terms lie in buckets of like counts, a
bucket's largest share and the smallest share the language gives to any of its terms bound all differences in it, and
buckets are evaluated best first until no unseen bound reaches the k-th best value. Distances of pairs come from
postings: only sources that both hold a term meet, in tiles, and the rest follows from counts of equal shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, lean, slices, term_lists, text_bytes

#: Letters A-Z, which count as a-z, and all that is not ASCII are parts of terms.
LETTERS = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 0x20 for c in range(256))
#: Terms a task holds before it hands over what it has counted; a bound of memory, not of the terms that count.
HOLD_TERMS = 300_000
#: Sources in one side of a tile of pairs, and tiles a task sums up at a time.
TILE, TILES = 256, 32
#: Count buckets to each doubling of the count.
FINE = 8


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, d): occurrences and documents, pre-aggregated within the task."""
    names = ["lang", "source", "term", "n", "d"]
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def hand_over() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            if n:
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = lambda x, k=len(n): pa.array([x] * k, pa.string())
                yield pa.record_batch([same(lang), same(source), terms, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names)
        held.clear()

    for b in slices(batches):
        for text, lang, source in zip(b.column("text"), b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in term_lists(text.as_buffer().to_pybytes(), LETTERS):
                n.update(words)
                seen.update(words)
            d.update(seen)
        if sum(len(n) for n, _ in held.values()) > HOLD_TERMS:
            yield from hand_over()
    yield from hand_over()


def _share(count: str, total: str) -> Column:
    """The smoothed share of a count in a total over the v kept terms, in parts of 10**9, exact at any size."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 5 as decimal(20,0))) div (cast({total} as decimal(20,0)) + cast(5 * v as decimal(20,0)))")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs of sources, summed over the terms that both hold: what their shares differ by, less what each differs from the other's share of absent terms, plus what those differ.

    A source without the term has zeros, with which the four parts cancel out.
    """
    held: dict[tuple[str, int, int], np.ndarray] = {}

    def hand_over() -> Iterator[pa.RecordBatch]:
        for (lang, x, y), m in held.items():
            a, b = np.nonzero(np.triu(m, 1) if x == y else m)
            if len(a):
                yield pa.record_batch([pa.array([lang] * len(a), pa.string()), pa.array(a + x * TILE, pa.int64()), pa.array(b + y * TILE, pa.int64()), pa.array(m[a, b], pa.int64())], ["lang", "a", "b", "value"])
        held.clear()

    def dense(lists: pa.ListArray, block: int) -> tuple[np.ndarray, np.ndarray]:
        flat = lists.flatten()
        at = flat.field("i").to_numpy(zero_copy_only=False) - block * TILE
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        p, z = (np.zeros((len(lists), int(at.max()) + 1), np.int64) for _ in range(2))
        p[row, at] = flat.field("p").to_numpy(zero_copy_only=False)
        z[row, at] = flat.field("p0").to_numpy(zero_copy_only=False)
        return p, z

    for b in slices(batches):
        lang, x, y = b.column("lang").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist()
        rows: dict[tuple[str, int, int], list[int]] = {}
        for i, key in enumerate(zip(lang, x, y, strict=True)):
            rows.setdefault(key, []).append(i)
        for key, at in rows.items():
            if key not in held and len(held) >= TILES:
                yield from hand_over()
            sums = held.setdefault(key, np.zeros((TILE, TILE), np.int64))
            (p, z), (r, u) = (dense(b.column(c).take(pa.array(at)), k) for c, k in (("left", key[1]), ("right", key[2])))
            for i in range(p.shape[1]):
                on = np.flatnonzero(z[:, i])
                if len(on):
                    s, t, right, absent = p[on, i, None], z[on, i, None], r[on], u[on]
                    part = np.abs(s - right) - np.abs(s - absent) - np.abs(t - right) + np.abs(t - absent)
                    sums[i, : r.shape[1]] += part.sum(axis=0)
    yield from hand_over()


def audit_sources(docs: DataFrame, least_docs: int = 30, k: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of docs (doc_id, text, lang, source, ...).

    A term is a run of letters (A-Z as a-z) and of characters beyond ASCII; each language keeps its V terms that at least
    least_docs of its documents hold. A group, or a whole language, gives a kept term that occurs count times there the share
    p = 1 + floor(10**9 * (count + 5) / (N + 5 V)), N its occurrences of all kept terms. Part "pair" ranks every other source
    of the language by the sum of abs(p - q) over all kept terms (0 where none is kept), part "term" the k kept terms
    which the group holds and gives a larger share than its language, by the difference. Ranks fall with the value; equal
    values are ranked by item in UTF-8. All arithmetic is exact.

    Null text, lang and source count as ''. Empty texts, and groups without kept terms, have pairs but no terms; a language
    of one source has no pairs. Each row of docs counts as a document, repeated ones too. An empty table gives no rows.
    Other columns are left out. Counts are summed within tasks first, so a source with a third of all rows, or a term of
    every document, sends no more rows than any other.
    """
    shelf = Shelf(docs.sparkSession, "divergence")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts = docs.select(text_bytes().alias("text"), name("lang"), name("source"))
    groups = docs.select(name("lang"), name("source")).distinct()

    # all rows of a term go to one partition once: first its counts by source, then its documents and occurrences in the language
    counted = texts.mapInArrow(lean(_counted), "lang string, source string, term string, n long, d long").repartition("lang", "term")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    one = Window.partitionBy("lang", "term")
    kept = counted.withColumn("docs", F.sum("d").over(one)).withColumn("all_n", F.sum("n").over(one)).filter(F.col("docs") >= least_docs)
    kept = shelf.put(kept.select("lang", "term", "source", "n", "all_n", (F.row_number().over(one.orderBy("source")) == 1).alias("first")), "kept")
    totals = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["v", "lang_total", "total"])
    groups = groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = shelf.put(groups.withColumn("p0", F.when(F.col("v") > 0, _share("0L", "total")).otherwise(0)), "groups")
    posted = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total")).withColumn("q", _share("all_n", "lang_total"))
    posted = shelf.put(posted.select("lang", "source", "i", "term", "p", "q", "p0", F.floor(F.log2("n") * FINE).cast("int").alias("bucket")), "postings")

    pairs = _pairs(posted, groups)
    terms = _standing_out(posted, k, shelf)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return both.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def _pairs(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways.

    A term that neither holds adds what their shares of absent terms differ by; one that a alone holds adds instead what a's
    share differs from b's of an absent term; for those that both hold, _tiles() puts right what counting both as such gave.
    """
    side = lambda x, c: groups.select("lang", F.col("i").alias(x), F.col("p0").alias("p0" + x), F.col("source").alias(c), *(["v"] if x == "a" else []))
    two = side("a", "source").join(side("b", "item"), "lang").filter("a != b")
    apart = F.abs(F.col("p0a") - F.col("p0b"))
    none = two.select("lang", "a", "b", (F.col("v") * apart).alias("value"))
    equal = posted.groupBy("lang", F.col("i").alias("a"), "p").agg(F.count("*").alias("times"))
    alone = two.join(equal, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("times") * (F.abs(F.col("p") - F.col("p0b")) - apart)).alias("value"))
    tile = posted.groupBy("lang", "term", F.floor(F.col("i") / TILE).cast("int").alias("x")).agg(F.collect_list(F.struct("i", "p", "p0")).alias("left"))
    met = tile.join(tile.select("lang", "term", F.col("x").alias("y"), F.col("left").alias("right")), ["lang", "term"]).filter("x <= y")
    common = met.select("lang", "x", "y", "left", "right").mapInArrow(lean(_tiles), "lang string, a long, b long, value long")
    back = lambda d: d.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    parts = none.unionByName(alone).unionByName(back(alone)).unionByName(common).unionByName(back(common))
    value = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return two.join(value, ["lang", "a", "b"]).select("lang", "source", "item", "value")


def _standing_out(posted: DataFrame, k: int, shelf: Shelf) -> DataFrame:
    """(lang, source, term, value, rank): the k terms of each group with the largest p - q above 0.

    Buckets are opened best bound first, a few times as many terms a round as are asked for, then four times as many as
    before. A group is done when all its unopened bounds are below its k-th value, which ties would have to equal.
    """
    group = ["lang", "source"]
    bounds = posted.groupBy(*group, "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("terms")).filter("bound > 0")
    first = Window.partitionBy(*group).orderBy(F.col("bound").desc(), "bucket")
    bounds = shelf.put(bounds.withColumn("before", F.sum("terms").over(first.rowsBetween(Window.unboundedPreceding, 0)) - F.col("terms")), "bounds")
    order = Window.partitionBy(*group).orderBy(F.col("value").desc(), "term")
    best, low, high = None, 0, 4 * k
    unseen = bounds
    while True:
        opened = unseen.filter((F.col("before") >= low) & (F.col("before") < high)).select(*group, "bucket")
        found = posted.join(opened, [*group, "bucket"]).filter("p > q").select(*group, "term", (F.col("p") - F.col("q")).alias("value"))
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = shelf.put(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        kth = best.filter(F.col("rank") == k).select(*group, F.col("value").alias("kth"))
        unseen = bounds.filter(F.col("before") >= high).join(kth, group, "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).drop("kth")
        if unseen.isEmpty():
            return best
        low, high = high, 4 * high
