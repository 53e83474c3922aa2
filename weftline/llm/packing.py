"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights with knapsack pricing, then rounded."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, arrow_map, keeps, text_bytes

#: Words whose ids a Python worker keeps before it empties the table.
KEEP_WORDS = 300_000
#: Pieces of one length that one task ranks, about.
RANK_ROWS = 100_000


class WordBPE:
    """The ids of a word-level BPE file (word ends marked, lower case, white space dropped), word by word.

    The file's merges are handed to tiktoken with a space standing for the end of a word, which no word holds;
    words are what ASCII white space separates, as neither the file's pattern nor its merges cross it.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # the printable bytes stand for themselves, the other bytes for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks, end = {}, np.zeros(max(vocab.values()) + 1, bool)
        special = {t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()}
        for token, i in vocab.items():
            if token in special:
                continue
            if token.endswith("</w>") and len(token) > 4:
                end[i] = True
                ranks[bytes(byte[c] for c in token[:-4]) + b" "] = i
            else:
                ranks[bytes(byte[c] for c in token)] = i
        self.end = end
        self.full = Tokenizer.from_file(path)
        self.bpe = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, bytes] = {}
        # the file's pattern on lower-case ASCII and Latin-1 letters
        self.parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
        # words whose lower case, composed form and pre-tokens all libraries agree on; the full tokenizer takes the rest
        self.plain = re.compile(r"[!-;=-~À-ÿ]+").fullmatch

    def learn(self, words: list[bytes]) -> None:
        """Keep the ids of words, which are distinct."""
        plain, rest = [], []
        for w, s in zip(words, b"\n".join(words).decode().split("\n"), strict=True):
            (plain if self.plain(s) else rest).append((w, s))
        if plain:
            # a space after each pre-token, a line for each word
            lines = self.parts.sub(r"\g<0> ", "\n".join([s for _, s in plain]).lower())
            raw = np.frombuffer(lines.encode(), np.uint8)
            done = np.cumsum(raw == 32)
            parts = np.append(done[raw == 10], done[-1])
            raw = bytes(self.bpe._core_bpe.encode_to_tiktoken_buffer(lines.replace("\n", ""), set()))
            stop, at = 4 * (np.flatnonzero(self.end[np.frombuffer(raw, np.uint32)])[parts - 1] + 1), 0
            for (w, _), to in zip(plain, stop.tolist(), strict=True):
                self.known[w] = raw[at:to]
                at = to
        for i in range(0, len(rest), 1000):
            part = rest[i : i + 1000]
            for (w, _), e in zip(part, self.full.encode_batch([s for _, s in part], add_special_tokens=False), strict=True):
                self.known[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts."""
        out = []
        for i in range(0, len(texts), 100):
            split = [t.split() for t in texts[i : i + 100]]
            got = [list(map(self.known.get, words)) for words in split]
            new = {w for words, ids in zip(split, got, strict=True) if None in ids for w, x in zip(words, ids, strict=True) if x is None}
            if new:
                if len(self.known) > KEEP_WORDS:
                    self.known.clear()
                self.learn(list(new))
                for words, ids in zip(split, got, strict=True):
                    if None in ids:
                        ids[:] = [x if x is not None else self.known[w] for w, x in zip(words, ids, strict=True)]
            out += map(b"".join, got)
        return out


@lru_cache(2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


keeps("ids", word_bpe.cache_clear)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids followed by id 0, cut at capacity."""

    def make():
        encode = word_bpe(tokenizer).encode
        step = 4 * capacity

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode(b.column("text").to_pylist())):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            return pa.record_batch([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return f

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), make, "doc_id long, piece int, start long, length long, ids_crc32 long", "ids")


def _price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: for each capacity the best value, and the length taken first (-1: leave one token free)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            v = best[c - lengths[:k]] + value[:k]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], took[c] = v[j], j
    return best, took


def _cover(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int) -> list[tuple[float, dict[int, int]]]:
    """The configuration linear program min sum(x) with sum(x_c * copies_c) >= need, by multiplicative weights.

    A weight starts at the tokens of its length and shrinks exponentially with the share of the need that is met,
    so lengths that lag are dear. In each round one price table serves patterns for every length, longest first: one
    copy of it and the dearest fill of the room it leaves, of lengths that are not yet met. A round meets one part in
    rounds of each need, a length that fills others up to two parts; a pattern is repeated until one of its lengths is
    met, so a round gives at most one pattern for each length and one more for each that is met. Patterns: (x, {index of length: copies}).
    """
    met, out, steps = np.zeros(len(lengths)), [], (0.5, 4.0)
    size = lengths.tolist()
    for r in range(1, rounds + 1):
        share = met / need
        eta = steps[0] + (steps[1] - steps[0]) * r / rounds
        value = lengths * np.exp(-eta * (share - share.min())) * (share < 1)
        best, took = _price(lengths, value, capacity)
        due = need * r / rounds - met
        spare = np.minimum(need, need * (r + 1) / rounds) - met
        open_value = np.where(spare > 1e-9, value, -np.inf)
        for i in range(len(size) - 1, -1, -1):
            while due[i] > 1e-9:
                pattern, c = {i: 1}, capacity - size[i]
                while c >= size[0]:
                    j = int(took[c])
                    if j < 0:
                        c -= 1
                        continue
                    if spare[j] <= 1e-9:
                        k = int(np.searchsorted(lengths, c, "right"))
                        v = best[c - lengths[:k]] + open_value[:k]
                        j = int(v.argmax())
                        if v[j] == -np.inf:
                            break
                    pattern[j] = pattern.get(j, 0) + 1
                    c -= size[j]
                x = due[i] / pattern[i]
                for j, k in pattern.items():
                    x = min(x, spare[j] / k)
                if x <= 0:
                    break
                out.append((x, pattern))
                for j, k in pattern.items():
                    met[j] += x * k
                    due[j] -= x * k
                    spare[j] -= x * k
                    if spare[j] <= 1e-9:
                        open_value[j] = -np.inf
    return out


def _best_fit(lengths: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing of the pieces that rounding leaves; a piece goes to the fullest sequence that has room."""
    room: list[list[dict[int, int]]] = [[] for _ in range(capacity + 1)]
    free, bins = np.zeros(capacity + 1, np.int64), []
    for n, k in sorted(zip(lengths.tolist(), need.tolist(), strict=True), reverse=True):
        for _ in range(k):
            at = n + int((free[n:] > 0).argmax())
            if free[at]:
                b = room[at].pop()
                free[at] -= 1
            else:
                at, b = capacity, {}
                bins.append(b)
            b[n] = b.get(n, 0) + 1
            room[at - n].append(b)
            free[at - n] += 1
    return [(1, b) for b in bins]


#: Rounds of the linear program over what each pass leaves. Passes take patterns that leave this part of a sequence free
#: at most, as long as each places a fiftieth of what was left, then larger parts.
ROUNDS, FREE = (8, 4, 2, 2, 1), (0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.03, 1.0)
PLACES = 0.02


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (how often, {length: copies}) that hold counts[length] pieces of each length exactly.

    The fractional solution of each pass is rounded, never above what is left, and what is left is solved again. Patterns
    that all but fill their sequences are rounded up or down, so that as many are taken as the solution takes in all, each
    pattern's fraction carried on to the next; in the last passes, whose patterns may waste room, they are rounded
    down. Best-fit decreasing places the rest, which is less than one set of pieces for each pattern of the last pass.
    Work, patterns and pieces left to best fit depend on capacity, the number of distinct lengths and rounds, not on
    the number of pieces. No pieces: no patterns.
    """
    lengths = np.array(sorted(n for n, k in counts.items() if k > 0), np.int64)
    left = np.array([counts[n] for n in lengths.tolist()], np.int64)
    times: dict[tuple[tuple[int, int], ...], int] = {}

    def add(n: int, pattern: dict[int, int]) -> None:
        key = tuple(sorted(pattern.items(), reverse=True))
        times[key] = times.get(key, 0) + n

    full = lengths == capacity
    if full.any():
        add(int(left[full][0]), {capacity: 1})
        lengths, left = lengths[~full], left[~full]
    for free in FREE:
        turn = 0
        while left.any():
            on, before, carried = np.flatnonzero(left), left.sum(), 0.0
            for x, pattern in _cover(lengths[on], left[on].astype(float), capacity, ROUNDS[min(turn, len(ROUNDS) - 1)]):
                if capacity - sum(int(lengths[on[j]]) * k for j, k in pattern.items()) > free * capacity:
                    continue
                whole = int(x + 1e-9)
                carried = min(carried + x - whole, 1.0) if free < 1 else 0.0
                wanted = whole + (carried > 1 - 1e-9)
                n = min(wanted, *(int(left[on[j]]) // k for j, k in pattern.items()), 1 << 62)
                if n:
                    carried -= n > whole
                    add(n, {int(lengths[on[j]]): k for j, k in pattern.items()})
                    for j, k in pattern.items():
                        left[on[j]] -= n * k
            turn += 1
            if left.sum() > (1 - PLACES) * before:
                break
    for n, pattern in _best_fit(lengths, left, capacity):
        add(n, pattern)
    return [(n, dict(key)) for key, n in times.items()]


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes: for each run of ranks the first sequence, copies in a sequence and first offset."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for times, pattern in patterns:
        at = 0
        for n, k in pattern.items():
            r = rank.get(n, 0)
            rows.append((n << 44 | r, n, r, first, k, at))
            rank[n] = r + times * k
            at += n * k
        first += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return dict(zip(("key", "length", "rank", "first", "copies", "offset"), a.T.copy(), strict=True))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset, in as few sequences of capacity as the method finds.

    length is from 1 to capacity. Only the histogram of lengths, at most capacity rows, reaches the driver; the plan
    that goes back holds a row for each pattern and length, whose number depends on capacity, not on the pieces. Ranks inside a length are dealt
    over buckets of about RANK_ROWS rows, so that a length that holds a third of all pieces is no single task's.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    shelf = Shelf(spark, "pack")
    pieces = shelf.put(pieces, "pieces")
    buckets = max(64, pieces.count() // RANK_ROWS)
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = shelf.put(dealt.groupBy("length", "__bucket").agg(F.count("*").alias("n")), "sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(pack_histogram(histogram, capacity)))

    before = sizes.withColumn("__before", F.sum("n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before.select("length", "__bucket", F.coalesce("__before", F.lit(0)).alias("__before")), ["length", "__bucket"])
    names = pieces.columns
    ranked = ranked.select(*names, (F.col("__rank") + F.col("__before")).alias("__rank"))

    def make():
        s = slots.value

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            n, r = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            i = np.searchsorted(s["key"], n << 44 | r, "right") - 1
            r = r - s["rank"][i]
            return pa.record_batch([*(b.column(c) for c in names), pa.array(s["first"][i] + r // s["copies"][i]), pa.array(s["offset"][i] + r % s["copies"][i] * n)], [*names, "sequence_id", "offset"])

        return f

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "__rank")
    return arrow_map(ranked, make, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Whole documents (doc_id, text, ...) as token pieces in sequences of at most capacity tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null text counts as empty, which is the
    closing id 0 alone; only documents longer than capacity are cut. Rows that repeat a doc_id are packed each.
    Other columns are left out.
    """
    out = pack(tokenized_pieces(docs, tokenizer, capacity), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
