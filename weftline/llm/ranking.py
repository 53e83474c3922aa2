"""Ranked lexical search over inverted treaps: search trees by doc_id that are heaps by impact, walked together for all terms of an item.

The root of a term's tree over any interval of documents is its best one there, so the sum of the roots bounds every
score in the interval. Intervals are opened best bound first; one whose bound cannot enter the best k is dropped whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, lean, mix, slices, term_lists, text_bytes

#: Letters A-Z, which count as a-z, digits and all that is not ASCII are parts of terms.
LETTERS = bytes(c if c >= 0x80 or 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 0x20 for c in range(256))
#: UTF-8 bytes of items whose terms are sent to all tasks at a time; more items are ranked in further blocks.
ITEM_BYTES = 8 << 20
#: Documents and postings of one set of trees, and terms of the items that search it together.
SHARD_DOCS, SHARD_POSTINGS, TOGETHER = 16_384, 2_000_000, 2_048
#: Intervals an item opens in one step: few at first, while its k-th score is still low.
OPEN = (4, 64)
NO_ID = (1 << 63) - 1


def _hits(terms: dict[bytes, int]):
    """Of each document its number of terms, and which of terms it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, held, times = [], [], []
            for text in b.column("text"):
                size, found = 0, Counter()
                for words in term_lists(text.as_buffer().to_pybytes(), LETTERS):
                    size += len(words)
                    found.update(filter(terms.__contains__, words))
                n.append(size)
                held.append([terms[t] for t in found])
                times.append(list(found.values()))
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"])

    return run


class Treaps:
    """The trees of all terms over one set of documents, which are numbered by ascending doc_id.

    Equal impacts are ordered by a hash of the document, so that ties don't make a tree a list.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> None:
        order = np.lexsort((doc, term))
        self.term, self.doc, impact = term[order], doc[order], impact[order]
        self.docs = docs
        self.key = self.term.astype(np.int64) * docs + self.doc
        with np.errstate(over="ignore"):
            tie = mix(self.doc.astype(np.uint64) + np.uint64(1))
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((tie, impact))] = np.arange(len(doc))
        self.names, starts = np.unique(self.term, return_index=True)
        left, right, self.root = self._grow(rank.tolist(), [*starts.tolist(), len(doc)])
        # the last entry stands for an empty tree
        self.left, self.right = np.array([*left, -1], np.int32), np.array([*right, -1], np.int32)
        self.doc, self.impact = np.append(self.doc, -1), np.append(impact, 0)

    @staticmethod
    def _grow(rank: list[int], cuts: list[int]) -> tuple[list[int], list[int], np.ndarray]:
        """Children of each posting, and the root of each term's postings, which lie between two cuts."""
        left, right, roots = [-1] * len(rank), [-1] * len(rank), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            spine: list[int] = []
            for i in range(a, b):
                last, r = -1, rank[i]
                while spine and rank[spine[-1]] < r:
                    last = spine.pop()
                left[i] = last
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            roots.append(spine[0])
        return left, right, np.array(roots, np.int32)

    def roots(self, terms: np.ndarray) -> np.ndarray:
        """The root of each term's tree, -1 where it has none."""
        if not len(self.names):
            return np.full(terms.shape, -1, np.int32)
        at = np.minimum(np.searchsorted(self.names, terms), len(self.names) - 1)
        return np.where(self.names[at] == terms, self.root[at], -1).astype(np.int32)

    def impacts(self, terms: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impacts of terms [m, t] in the document of each row."""
        key = np.where(terms >= 0, terms.astype(np.int64) * self.docs + doc[:, None], -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.impact[at], 0)

    def within(self, tree: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The roots of what trees [m, t] hold from low to high of each row. A subtree reaches beyond the interval that its root was found for, so both ends count."""
        tree = tree.copy()
        while True:
            d = self.doc[tree]
            left, right = d > high[:, None], (d < low[:, None]) & (d >= 0)
            if not (left | right).any():
                return tree
            tree[left], tree[right] = self.left[tree[left]], self.right[tree[right]]


class Best:
    """The k best documents of each item so far, and what another one must have to enter."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.item, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least, self.last = np.ones(items, np.int64), np.full(items, NO_ID)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        on = score > 0
        item, score, doc = (np.concatenate([x, y[on]]) for x, y in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = rank == self.k - 1
        self.least[item[full]], self.last[item[full]] = score[full], doc[full]
        self.item, self.score, self.doc = (x[rank < self.k] for x in (item, score, doc))

    def may_enter(self, item: np.ndarray, bound: np.ndarray, first: np.ndarray) -> np.ndarray:
        """first: the smallest doc_id that could have the bound."""
        return (bound > self.least[item]) | ((bound == self.least[item]) & (first <= self.last[item]))


def search(trees: Treaps, ids: np.ndarray, items: np.ndarray, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
    """Walks the trees for some items (their numbers, terms [items, t], -1 where fewer, and how often each asks for them) and adds to best. ids: the ascending doc_ids. Returns how many documents were scored."""
    q = np.arange(len(items))
    low, high, tree = np.zeros(len(q), np.int64), np.full(len(q), trees.docs - 1), trees.roots(terms)
    bound = (times * trees.impact[tree]).sum(axis=1)
    open_, scored = OPEN[0], 0
    while True:
        on = np.flatnonzero((bound > 0) & best.may_enter(items[q], bound, ids[low]))
        if not len(on):
            return scored
        q, low, high, tree, bound = q[on], low[on], high[on], tree[on], bound[on]
        order = np.lexsort((-bound, q))
        ranked = q[order]
        now = np.zeros(len(q), bool)
        now[order[np.arange(len(q)) - np.searchsorted(ranked, ranked) < open_]] = True
        open_ = min(2 * open_, OPEN[1])
        p, a, z, t = q[now], low[now], high[now], tree[now]
        # an interval is cut at the document that the largest of its roots belongs to
        root = t[np.arange(len(p)), (times[p] * trees.impact[t]).argmax(axis=1)]
        d = trees.doc[root].astype(np.int64)
        best.add(items[p], (times[p] * trees.impacts(terms[p], d)).sum(axis=1), ids[d])
        scored += len(p)
        parts = [(q[~now], low[~now], high[~now], tree[~now], bound[~now])]
        for from_, to in ((a, d - 1), (d + 1, z)):
            sub = trees.within(t, from_, to)
            b = (times[p] * trees.impact[sub]).sum(axis=1)
            some = (from_ <= to) & (b > 0)
            parts.append((p[some], from_[some], to[some], sub[some], b[some]))
        q, low, high, tree, bound = (np.concatenate(x) for x in zip(*parts, strict=True))


def _ranked(shared, k: int):
    """The k best documents of each item among a task's documents: item, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight, n_docs, all_terms = shared.value
        best = Best(len(asked), k)
        # items with like numbers of terms search together
        size = np.array([len(x) for x in asked], np.int64)
        together, group = [], []
        for i in (i for i in np.argsort(size, kind="stable").tolist() if size[i]):
            if group and (len(group) + 1) * size[i] > TOGETHER:
                together.append(group)
                group = []
            group.append(i)
        together += [group] if group else []

        def padded(group: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            terms, times = np.full((len(group), size[group].max()), -1, np.int64), np.zeros((len(group), size[group].max()), np.int64)
            for row, i in enumerate(group):
                terms[row, : size[i]], times[row, : size[i]] = zip(*asked[i].items(), strict=True)
            return np.array(group), terms, times

        together = [padded(g) for g in together]

        def one_set(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held)
            ids = np.array(t.column("doc_id").fill_null(NO_ID).to_numpy())
            order = np.argsort(ids, kind="stable")
            number = np.empty(len(ids), np.int64)
            number[order] = np.arange(len(ids))
            lists = t.column("terms").combine_chunks()
            row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            term, tf = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "tf"))
            m = 75 + 25 * np.array(t.column("n").to_numpy()) * n_docs // all_terms
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
            trees = Treaps(term.astype(np.int64), number[row], impact, len(ids))
            for group, terms, times in together:
                search(trees, ids[order], group, terms, times, best)

        held, docs, postings = [], 0, 0
        for b in slices(batches):
            held.append(b)
            docs, postings = docs + b.num_rows, postings + len(b.column("terms").flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                one_set(held)
                held, docs, postings = [], 0, 0
        if postings:
            one_set(held)
        yield pa.record_batch([pa.array(best.item.astype(np.int32)), pa.array(best.doc, mask=best.doc == NO_ID), pa.array(best.score)], ["item", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs (doc_id, text) for each row of items (item_id, text).

    Terms are runs of letters (A-Z as a-z), digits and characters beyond ASCII. N counts the documents with a term, L all
    their terms; a term in df documents weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document of n terms has
    m = 75 + 25 n N div L, and scores the sum over the item's terms, repeats included, of
    w * (10**9 tf div (1000 tf + 12 m)). Only scores above 0 are ranked, equal ones by ascending doc_id, a null doc_id last.

    Every row of docs is ranked, repeated ones too; of items that repeat id and text one is, and two texts under one id are
    ranked each. Null or empty texts, and items none of whose terms occurs, give no rows, nor does an empty table on either
    side. Other columns are left out.

    docs are read once for each ITEM_BYTES of items, whose terms are what tasks hold; postings of other terms are never
    made. Each task grows trees over sets of its own documents and keeps k rows an item, so a term of very many documents
    is in as many trees as there are sets, and what an item found in one set prunes the next.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "ranking")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    out = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        found = _block(spark, shelf, texts, [(r.item_id, bytes(r.text)) for r in rows], k)
        found = found.withColumn("block", F.lit(block))
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(spark, shelf: Shelf, texts: DataFrame, rows: list[tuple[int, bytes]], k: int) -> DataFrame:
    """item, item_id, doc_id, score: of every task the k best documents for each of rows."""
    number: dict[bytes, int] = {}
    asked = []
    for _, text in rows:
        words = Counter(w for part in term_lists(text, LETTERS) for w in part)
        asked.append({number.setdefault(w, len(number)): n for w, n in words.items()})
    named = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "item int, item_id long")
    hits = shelf.put(texts.mapInArrow(lean(_hits(number)), "doc_id long, n long, terms array<int>, tf array<long>").filter("n > 0"), "hits")
    n_docs, all_terms, with_hits = hits.agg(F.count("*"), F.sum("n"), F.count_if(F.size("terms") > 0)).first()
    weight = np.zeros(len(number), np.int64)
    for term, df in hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the block
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    shared = spark.sparkContext.broadcast((asked, weight, n_docs, all_terms))
    sets = hits.filter(F.size("terms") > 0).repartition(max(1, math.ceil(with_hits / SHARD_DOCS)))
    return sets.mapInArrow(lean(_ranked(shared, k)), "item int, doc_id long, score long").join(F.broadcast(named), "item")
