"""Document fingerprints: threshold-scaled sketches, which keep every shingle hash below a fixed fraction of the range.

Whether a hash is kept depends on it alone, so the sketch of two texts together is the union of their sketches, and what a
short text shares with a very long one can be told from sketches of both.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, lean, mix, shingle_set, slices, text_bytes

#: Words of a shingle, and the part of all hashes that is kept: one of SCALE.
WORDS, SCALE = 5, 4
#: Bits and bytes of a kept hash in the written form.
BITS, BYTES = 48, 6
#: Documents of one block of the order by doc_id, about; blocks at most, whose limits and first rows the driver holds.
BLOCK_ROWS, BLOCKS = 4_096, 20_000


class Sketch(NamedTuple):
    """A text's sketch: its number of distinct shingles, a digest of them all, and the kept hashes, ascending."""

    shingles: int
    digest: str
    kept: np.ndarray

    def written(self) -> str:
        raw = np.ascontiguousarray(self.kept.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :]
        return f"{self.shingles}:{self.digest}:{base64.b64encode(raw.tobytes()).decode()}"


def read_sketch(written: str) -> Sketch:
    shingles, digest, kept = written.split(":")
    raw = np.frombuffer(base64.b64decode(kept), np.uint8).reshape(-1, BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BYTES :] = raw
    return Sketch(int(shingles), digest, wide.view(">u8").ravel().astype(np.uint64))


def sketch(text: bytes, words: int = WORDS, scale: int = SCALE) -> Sketch:
    """The sketch of a text; A-Z count as a-z, a text of fewer words than a shingle is one shingle, one without words has none."""
    hashes = shingle_set(text, words)
    with np.errstate(over="ignore"):
        mixed = mix(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - BITS)
    return Sketch(len(hashes), hashlib.blake2b(hashes.tobytes(), digest_size=8).hexdigest(), np.unique(mixed[mixed < np.uint64((1 << BITS) // scale)]))


def merged(a: Sketch, b: Sketch) -> np.ndarray:
    """The kept hashes of both texts together."""
    return np.union1d(a.kept, b.kept)


def _common(a: Sketch, b: Sketch) -> int:
    return len(np.intersect1d(a.kept, b.kept, assume_unique=True))


def likeness(a: Sketch, b: Sketch) -> float:
    """The estimated part of the shingles of either that both have; 1 exactly where the digests of all shingles are equal."""
    if a.digest == b.digest:
        return 1.0
    both = _common(a, b)
    return both / max(1, len(a.kept) + len(b.kept) - both)


def containment(a: Sketch, b: Sketch) -> float:
    """The estimated part of a's shingles that b has, however much longer b is; 1 for an empty text."""
    if a.digest == b.digest or not a.shingles:
        return 1.0
    return _common(a, b) / max(1, len(a.kept))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one, or all of that."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _sent(limits: np.ndarray, spans: np.ndarray, heads: dict[tuple[int | None, int], list[int]]):
    """Rows with the block of the order they are in, compressed; the first row of a block also goes to the block before, as its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in slices(batches):
            ids, hashes = b.column("doc_id").to_pylist(), b.column("h").to_pylist()
            at = blocks_of(ids, np.array(hashes, np.int64), limits, spans)
            rows = [(int(k), 0, i) for i, k in enumerate(at)]
            rows += [(k, 1, i) for i, key in enumerate(zip(ids, hashes, strict=True)) for k in heads.get(key, ())]
            take = pa.array([i for *_, i in rows])
            texts = [pack(x.as_buffer()) for x in b.column("text")]
            yield pa.record_batch([pa.array([k for k, *_ in rows], pa.int32()), pa.array([h for _, h, _ in rows], pa.int32()), b.column("doc_id").take(take), b.column("h").take(take), pa.array([texts[i] for *_, i in rows], pa.binary())], ["block", "head", "doc_id", "h", "packed"])

    return run


def blocks_of(ids: list, hashes: np.ndarray, limits: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The block of each (doc_id, hash of text). limits: ascending doc_ids where blocks end; one that holds several of them is itself cut by the hash, into spans pieces. Null ids are below all others."""
    known = np.array([x is not None for x in ids], bool)
    x = np.array([x if x is not None else 0 for x in ids], np.int64)
    low = np.where(known, np.searchsorted(limits, x, "left"), 0)
    pieces = np.where(known & (low < len(limits)) & (limits[np.minimum(low, len(limits) - 1)] == x), spans[np.minimum(low, len(limits) - 1)], 1) if len(limits) else np.ones(len(x), np.int64)
    # the place of the hash among all hashes, in pieces equal parts
    part = ((hashes.astype(np.float64) / 2.0**64 + 0.5) * pieces).astype(np.int64)
    return low + np.clip(part, 0, pieces - 1)


def _printed(words: int, scale: int):
    """Of rows in order, each block's followed by its head: the results, each row with the next one's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
        before = None
        for b in slices(batches):
            rows = []
            for block, head, doc_id, packed in zip(b.column("block").to_pylist(), b.column("head").to_pylist(), b.column("doc_id").to_pylist(), b.column("packed"), strict=True):
                raw = unpack(packed.as_buffer())
                text, own = raw.decode(), sketch(raw, words, scale)
                if before is not None and before[0] == block:
                    _, its_id, its_text, its = before
                    new = edited(its_text, text).encode()
                    other = sketch(new, words, scale)
                    rows.append((its_id, len(its_text), hashlib.sha256(new).hexdigest(), its.written(), other.written(), likeness(its, other), likeness(its, own), containment(its, other), containment(its, own)))
                before = None if head else (block, doc_id, text, own)
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def fingerprint_documents(docs: DataFrame, words: int = WORDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text, ...): its fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has its last n_chars div 3 code points replaced by the first as many, or all, of the next document by
    descending doc_id; the last is followed by the first. Columns: doc_id, n_chars (code points), edited_sha256 (of the
    UTF-8), fingerprint, edited_fingerprint (see Sketch.written), near_edited, near_next (estimated Jaccard likeness),
    contained_edited, contained_next (estimated part of the document's shingles that the other text has).

    Null text counts as empty: no shingles, like other empty texts alone. Texts with few shingles may keep no hash at all:
    their likeness is 1 to texts with equal shingles and 0 to others. Equal doc_ids are ordered by a hash of the text, null
    doc_ids come last, rows that repeat both follow each other. A single row follows itself. An empty table gives no rows.
    Other columns are left out.

    The order is cut into blocks at quantiles of doc_id, an id that many rows share into several by the hash. A block gets
    the first row of the next, so it is a stream of rows in which each needs the one after it; nothing else moves.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "fingerprints")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    keys = shelf.put(texts.select("doc_id", "h"), "keys")
    blocks = min(BLOCKS, math.ceil(keys.count() / block_rows))
    cuts = keys.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], max(10_000, 10 * blocks))).first()[0] if blocks > 1 else None
    # an id that k quantiles fall on is cut into k parts
    at, times = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    limits, spans = np.repeat(at, times), np.repeat(times, times)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.record_batch([pa.array(blocks_of(b.column("doc_id").to_pylist(), b.column("h").to_numpy(), limits, spans), pa.int32()), b.column("doc_id"), b.column("h")], ["block", "doc_id", "h"])

    first = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("x"), F.col("doc_id").isNotNull().alias("known"), "h")
    firsts = keys.mapInArrow(numbered, "block int, doc_id long, h long").groupBy("block").agg(F.max(first).alias("first")).orderBy(F.col("block").desc()).collect()
    heads: dict[tuple[int | None, int], list[int]] = {}
    for row, before in zip(firsts, [firsts[-1], *firsts[:-1]] if firsts else [], strict=True):
        heads.setdefault((row.first.x if row.first.known else None, row.first.h), []).append(before.block)
    sent = texts.mapInArrow(lean(_sent(limits, spans, heads)), "block int, head int, doc_id long, h long, packed binary")
    sent = sent.repartitionById(max(1, blocks), "block").sortWithinPartitions("block", "head", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return sent.mapInArrow(lean(_printed(words, scale), "words"), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double")
