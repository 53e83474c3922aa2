"""Toxicity scores: a factorization machine over hashed terms, whose pairwise interactions additive weights would miss."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keeps, lean, text_bytes

#: Hashed terms; with FACTORS of each of two machines this bounds the model at 2**18 * 17 * 4 bytes = 17.8 MB, whatever the corpus.
TERMS, FACTORS = 1 << 18, 8
#: Parts of the machine of pairs that are tried, and the rows and epochs it is fitted with.
SHARES = (0.0, 0.25, 0.5, 1.0)
PAIR_ROWS, PAIR_EPOCHS = 4_000, 6
#: How far a term must stand out by itself, in standard deviations, to have a quarter of the weight of one that is all telling.
DOUBT = 2.5
#: Labelled rows the model is fitted on at most, chosen by a hash of doc_id; each gives its distinct terms.
FIT_ROWS = 12_000
THRESHOLD = 0.3
FIT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("terms", pa.binary())])

_known: dict[bytes, tuple[int, ...]] = {}
KEEP_WORDS = 100_000
keeps("terms", _known.clear)
_edge = re.compile(r"^\W+|\W+$")


def _terms(word: bytes) -> tuple[int, ...]:
    """Hashed terms of a word: itself without marks at its ends, and its first 4 and 5 letters, as endings vary."""
    w = _edge.sub("", word.decode().lower())
    if not w:
        return ()
    out = [b"w " + w.encode()]
    if len(w) > 4:
        out += [b"4 " + w[:4].encode(), b"5 " + w[:5].encode()]
    return tuple(xxhash.xxh32_intdigest(x) % TERMS for x in out)


def document_terms(text: bytes) -> np.ndarray:
    """Sorted distinct terms of a whole text."""
    words = set(text.split())
    if len(_known) > KEEP_WORDS:
        _known.clear()
    for w in words.difference(_known):
        _known[w] = _terms(w)
    out: set[int] = set()
    out.update(*map(_known.__getitem__, words))
    return np.array(sorted(out), np.int64)


class FactorizationMachine:
    """score(x) = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i equal for the known terms of a document, of norm 1."""

    def __init__(self, known: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray, scale: float) -> None:
        self.known, self.bias, self.w, self.v, self.scale = known, bias, w, v, scale

    @classmethod
    def of(cls, at: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float) -> FactorizationMachine:
        """From the known terms alone, their weights and factors."""
        v = v.reshape(len(at), -1) if len(at) else np.zeros((0, FACTORS), np.float32)
        m = cls(np.zeros(TERMS, bool), bias, np.zeros(TERMS, np.float32), np.zeros((TERMS, v.shape[1]), np.float32), 1.0)
        m.known[at], m.w[at], m.v[at] = True, w, v
        return m

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """What of() makes it from."""
        at = np.flatnonzero(self.known).astype(np.int32)
        return at, self.w[at], self.v[at], self.bias

    def plus(self, other: FactorizationMachine, share: float) -> FactorizationMachine:
        """The machine whose logits are these and share times the other's."""
        v = np.concatenate([self.v, other.v * np.float32(share**0.5)], axis=1)
        return FactorizationMachine(self.known | other.known, self.bias + share * other.bias, self.w + np.float32(share) * other.w, v, 1.0)

    def logits(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """terms of all documents, one after another, which begin at starts (ascending, one past the end last)."""
        out = np.full(len(starts) - 1, self.bias, np.float64)
        on = self.known[terms]
        count = np.concatenate([[0], np.cumsum(on)])
        at, rows = terms[on], count[starts]
        full = np.flatnonzero(np.diff(rows))
        if len(full):
            begin, x = rows[full], self.scale
            s = np.add.reduceat(self.v[at], begin, axis=0)
            q = np.add.reduceat((self.v[at] ** 2).sum(axis=1), begin)
            out[full] += x * np.add.reduceat(self.w[at], begin) + 0.5 * x * x * ((s**2).sum(axis=1) - q)
        return out


def fit(terms: list[np.ndarray], y: np.ndarray, epochs: int = 14, seed: int = 7, pair_epochs: int = PAIR_EPOCHS) -> FactorizationMachine:
    """Two machines over all terms in at least 3 documents: one that trusts a term as far as it tells something alone, and on top of it one that trusts all alike.

    The second learns pairs of which neither term tells anything alone. Over all terms a few labels also teach much chance,
    so a fifth of the rows chooses its part, from SHARES, by log loss; this trial and the second machine take PAIR_ROWS
    rows at most. The first learns from all rows.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(terms))
    b, a = order[: len(terms) // 5], order[len(terms) // 5 :][:PAIR_ROWS]
    first = _fit(terms, y, epochs, seed)
    if not len(b):
        return first
    trial = _fit([terms[i] for i in a], y[a], epochs, seed)
    more = _fit([terms[i] for i in a], y[a], pair_epochs, seed, trial)
    starts = np.concatenate([[0], np.cumsum([len(terms[i]) for i in b])]).astype(np.int64)
    flat = np.concatenate([terms[i] for i in b])
    z, extra, sign = trial.logits(flat, starts), more.logits(flat, starts), np.where(y[b] > 0.5, -1, 1)
    share = SHARES[int(np.argmin([np.logaddexp(0, sign * (z + c * extra)).mean() for c in SHARES]))]
    if not share:
        return first
    some = order[:PAIR_ROWS]
    return first.plus(_fit([terms[i] for i in some], y[some], pair_epochs, seed, first), share)


def _fit(terms: list[np.ndarray], y: np.ndarray, epochs: int, seed: int, under: FactorizationMachine | None = None, batch: int = 128) -> FactorizationMachine:
    """Logistic loss, minibatches and AdaGrad. Without under, a term's value is what its counts in both labels tell beyond chance; with it, terms are all 1, for what is left of under's logits. No rows, or one label alone: the share of label 1 for all."""
    n, share = len(terms), float(y.mean()) if len(y) else 0.0
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if n == 0 or share in (0.0, 1.0):
        return FactorizationMachine.of(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32), bias)
    flat, sizes = np.concatenate(terms), np.array([len(t) for t in terms])
    df, pos = np.bincount(flat, minlength=TERMS), np.bincount(flat, np.repeat(y, sizes), minlength=TERMS)
    known = np.flatnonzero(df >= 3)
    place = np.full(TERMS, -1, np.int32)
    place[known] = np.arange(len(known))
    flat = place[flat]
    sizes = np.add.reduceat(np.append(flat >= 0, 0), np.concatenate([[0], np.cumsum(sizes)[:-1]])) * (sizes > 0)
    flat = flat[flat >= 0]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    if under is None:
        # alone, terms alike in both labels mostly add noise
        z = (pos[known] - df[known] * share) / np.sqrt(df[known] * share * (1 - share))
        x, base = (z**2 / (z**2 + DOUBT**2)) ** 2, np.zeros(n)
    else:
        x, bias, base = np.ones(len(known)), 0.0, under.logits(known[flat], starts)
    x, m = x.astype(np.float32), len(known)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(m, np.float32), rng.normal(0, 0.1, (m, FACTORS)).astype(np.float32)
    gw, gv, gb = np.full(m, 1e-2, np.float32), np.full((m, FACTORS), 1e-2, np.float32), 1e-2
    rate, l2 = 0.25, 1e-4
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            part = order[a : a + batch]
            some = part[sizes[part] > 0]
            if not len(some):
                continue
            f, size = np.concatenate([flat[starts[i] : starts[i + 1]] for i in some]), sizes[some]
            begin, xf = np.concatenate([[0], np.cumsum(size)[:-1]]), x[f]
            vf = v[f] * xf[:, None]
            s = np.add.reduceat(vf, begin, axis=0)
            z = base[some] + bias + np.add.reduceat(w[f] * xf, begin) + 0.5 * ((s**2).sum(axis=1) - np.add.reduceat((vf**2).sum(axis=1), begin))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[some]) / len(part)
            gx = np.repeat(g, size).astype(np.float32) * xf
            apart = np.repeat(s, size, axis=0) - vf
            seen = np.bincount(f, minlength=m) > 0
            dw = (np.bincount(f, gx, m) + l2 * w) * seen
            gw += dw**2
            w -= (rate * x * dw / np.sqrt(gw)).astype(np.float32)
            for j in range(FACTORS):
                dv = (np.bincount(f, gx * apart[:, j], m) + l2 * v[:, j]) * seen
                gv[:, j] += dv**2
                v[:, j] -= (0.4 * rate * x * dv / np.sqrt(gv[:, j])).astype(np.float32)
            gb += g.sum() ** 2
            bias -= 0.1 * rate * g.sum() / gb**0.5
    return FactorizationMachine.of(known.astype(np.int32), w * x, v * x[:, None], bias)


def held_out(c: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = FIT_ROWS) -> FactorizationMachine:
    """The model of labels (doc_id, toxic) on the texts of docs, from labelled rows that are not held out.

    At most rows of them are used, those with the smallest hash of their id: the bounded sample that the model is
    fitted on. Rows without label or id are not used; of contradicting labels of one id the larger counts.
    """
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    known = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    sample = d.join(F.broadcast(known), "doc_id")  # at most rows ids

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            t = [document_terms(x).astype(np.int32).tobytes() for x in b.column("text").to_pylist()]
            return pa.record_batch([b.column("doc_id"), b.column("y"), pa.array(t, pa.binary())], ["doc_id", "y", "terms"])

        return f

    terms = arrow_map(sample.select("doc_id", "y", "text"), make, "doc_id long, y int, terms binary", "terms")

    def fitted(batches):
        """The model of all rows, as its known terms with their weights."""
        got = pa.Table.from_batches(batches, FIT_SCHEMA).sort_by([("doc_id", "ascending"), ("terms", "ascending")])
        # views of the received bytes, not copies
        m = fit([np.frombuffer(t.as_buffer(), np.int32) for t in got["terms"]], got["y"].to_numpy().astype(np.float64))
        *parts, bias = m.parts()
        yield pa.record_batch([*(pa.array([x.tobytes()], pa.binary()) for x in parts), pa.array([bias])], ["at", "w", "v", "bias"])

    # at most rows rows meet in one task, so that the driver holds neither the sample nor what fitting needs
    row = terms.repartition(1).mapInArrow(lean(fitted), "at binary, w binary, v binary, bias double").first()
    return FactorizationMachine.of(np.frombuffer(row.at, np.int32), np.frombuffer(row.w, np.float32), np.frombuffer(row.v, np.float32), row.bias)


def score(docs: DataFrame, model: FactorizationMachine, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (default doc_id) and score, from 0 to 1, of every row's whole text; a column called score in keep gives way to it.

    Null or empty text has the score of a text without known terms. Labels, languages and sources are not read.
    """
    keep = [c for c in (["doc_id"] if keep is None else keep) if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    # a text that is kept is sent once
    own = keep.index("text") if "text" in keep and dict(docs.dtypes)["text"] == "string" else len(keep)

    def make():
        m = FactorizationMachine.of(*shared.value)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            texts = b.column(own).cast(pa.binary()).to_pylist()
            for i in range(0, len(texts), 256):
                t = [document_terms(x or b"") for x in texts[i : i + 256]]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in t])]).astype(np.int64)
                out.append(m.logits(np.concatenate(t), starts))
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(out), -40, 40)))
            return pa.record_batch([*b.columns[: len(keep)], pa.array(p)], [*(f"c{i}" for i in range(len(keep))), "p"])

        return f

    d = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), *([text_bytes().alias("t")] if own == len(keep) else []))
    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    return arrow_map(d, make, f"{kinds}p double", "terms").toDF(*keep, "score")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text, ...); see train() and score()."""
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
