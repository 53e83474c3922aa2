"""Token counts under a unigram model: distinct pre-tokens share a trie, and forward scores are computed once for each shared prefix."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keeps, text_bytes

#: Pre-tokens whose counts a Python worker keeps before it empties the table; a bound of memory only.
KEEP_WORDS = 400_000
#: Letters down to which new pre-tokens share a trie; what is longer goes on alone from its node there.
DEPTH = 48
#: Score of a byte of a character that is no piece.
BYTE = -16.0
#: Bits of a character in the keys of the pieces' trie.
CHAR = 21


@lru_cache(2)
def piece_scores(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with log-probabilities by Zipf's law of their rank; control, byte and unknown pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): -math.log(10 + i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}


def _runs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that repeat n times each: the row of every repeat, and its number inside the row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


class SharedTrie:
    """counts(words): the number of tokens of the best segmentation of each word, the first of equals.

    The words stand in a trie, of which one level at a time is held, in flat arrays. A node is a prefix of words: its
    best score, the tokens of it, and its live entries, the places in the pieces' own trie where pieces that began in
    the prefix may still go on. A level is computed for all its nodes at once, so a prefix costs as much as its live
    entries, however many words share it.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        nodes: dict[tuple[int, int], int] = {}
        score = [-math.inf]
        for p, s in scores.items():
            at = 0
            for ch in p:
                nxt = nodes.setdefault((at, ord(ch)), len(score))
                if nxt == len(score):
                    score.append(-math.inf)
                at = nxt
            score[at] = s
        self.nodes = nodes
        self.score = np.array(score)
        key = np.array([at << CHAR | ch for at, ch in nodes], np.int64)
        order = np.argsort(key)
        self.key, self.to = key[order], np.array(list(nodes.values()), np.int64)[order]
        self.known: dict[bytes, int] = {}

    def _go(self, state: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """Where a character leads from each state of the pieces' trie; -1 if nowhere."""
        if not len(self.key):
            return np.full(len(state), -1)
        k = state << CHAR | ch
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.to[at], -1)

    def counts(self, words: list[str]) -> list[int]:
        out: list[int] = [0] * len(words)
        # equal words are one, and those that share a prefix are neighbours
        distinct = sorted(set(words))
        place = {w: i for i, w in enumerate(distinct)}
        size = np.array([len(w) for w in distinct], np.int64)
        text = np.frombuffer("".join(distinct).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.cumsum(size) - size
        total = np.zeros(len(distinct), np.int64)
        word = np.flatnonzero(size)  # words that go on, and the node each is at
        node = np.zeros(len(word), np.int64)
        best, tokens = np.zeros(1), np.zeros(1, np.int64)
        # live entries, node after node: state in the pieces' trie, score and tokens before the piece
        first, state, base, before = np.zeros(2, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for depth in range(DEPTH):
            if not len(word):
                break
            ch = text[start[word] + depth]
            new = np.ones(len(word), bool)
            new[1:] = (node[1:] != node[:-1]) | (ch[1:] != ch[:-1])
            up, c = node[new], ch[new]
            node = np.cumsum(new) - 1
            n = first[up + 1] - first[up]
            # the parent's live entries, oldest first, then a piece that begins here
            row, k = _runs(n + 1)
            begins = k == n[row]
            at = np.where(begins, 0, first[up][row] + k)
            if len(state):
                came, b, t = np.where(begins, 0, state[at]), np.where(begins, best[up][row], base[at]), np.where(begins, tokens[up][row], before[at])
            else:
                came, b, t = np.zeros(len(row), np.int64), best[up][row], tokens[up][row]
            state = self._go(came, c[row])
            on = state >= 0
            alone = np.flatnonzero(begins)
            single = np.where(on[alone], self.score[state[alone]], -math.inf) > -math.inf  # the character itself is a piece
            row, state, base, before = row[on], state[on], b[on], t[on]
            first = np.searchsorted(row, np.arange(len(c) + 1))
            ends = base + self.score[state]
            top = np.full(len(c), -math.inf)
            np.maximum.at(top, row, ends)
            count = np.zeros(len(c), np.int64)
            hit = np.flatnonzero((ends == top[row]) & (ends > -math.inf))[::-1]
            count[row[hit]] = before[hit] + 1  # in reverse: the first of equals stays
            width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
            spelt = best[up] + BYTE * width
            use = ~single & (spelt > top)
            best, tokens = np.where(use, spelt, top), np.where(use, tokens[up] + width, count)
            done = size[word] == depth + 1
            total[word[done]] = tokens[node[done]]
            word, node = word[~done], node[~done]
        for w, i in zip(word.tolist(), node.tolist(), strict=True):
            a, z = int(first[i]), int(first[i + 1])
            total[w] = self._alone(distinct[w], float(best[i]), int(tokens[i]), list(zip(state[a:z].tolist(), base[a:z].tolist(), before[a:z].tolist(), strict=True)))
        for i, w in enumerate(words):
            out[i] = int(total[place[w]])
        return out

    def _alone(self, word: str, best: float, tokens: int, live: list[tuple[int, float, int]]) -> int:
        """What is left of one long word behind its node at DEPTH."""
        go, score = self.nodes.get, self.score
        for ch in word[DEPTH:]:
            c, top, count, on = ord(ch), -math.inf, 0, []
            for at, b, t in [*live, (0, best, tokens)]:
                nxt = go((at, c))
                if nxt is not None:
                    on.append((nxt, b, t))
                    if b + score[nxt] > top:
                        top, count = b + score[nxt], t + 1
            own = go((0, c))
            if own is None or score[own] == -math.inf:
                size = len(ch.encode())
                if best + BYTE * size > top:
                    top, count = best + BYTE * size, tokens + size
            best, tokens, live = top, count, on
        return tokens


@lru_cache(2)
def shared_trie(path: str) -> SharedTrie:
    return SharedTrie(piece_scores(path))


def _forget() -> None:
    piece_scores.cache_clear()
    shared_trie.cache_clear()


keeps("trie", _forget)


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row of docs (doc_id, text, ...), over the whole text.

    Pre-tokens are the words that ASCII white space separates, each led by the pieces' word mark. Null or empty text:
    0 and 0; an empty table gives no rows. Rows stay as they are, repeats and null ids included; other columns are left
    out. Nothing is shuffled: a worker puts the new pre-tokens of a slice of documents into one trie and keeps terminal
    counts, KEEP_WORDS of them at most, so that a frequent word is segmented once in each worker.
    """

    def make():
        trie = shared_trie(model)
        known = trie.known

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            split = [t.split() for t in b.column("text").to_pylist()]
            if len(known) > KEEP_WORDS:
                known.clear()
            new = list(set().union(*split).difference(known))
            # a separator that no pre-token holds: one decoding for all
            texts = b"\n".join(new).decode().split("\n") if new else []
            for w, n in zip(new, trie.counts(["▁" + t for t in texts]), strict=True):
                known[w] = n
            tokens = [sum(map(known.__getitem__, w)) for w in split]
            return pa.record_batch([b.column("doc_id"), pa.array([len(w) for w in split], pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

        return f

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), make, "doc_id long, n_pretokens long, n_tokens long", "trie")
