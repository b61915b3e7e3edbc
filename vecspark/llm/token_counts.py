"""Operator 1: token counts by dynamic programming over a trie of pre-tokens.

The best segmentation score of a pre-token's first i characters depends on those characters alone,
so pre-tokens that share a prefix share its forward scores. The distinct new pre-tokens of a slice of
documents are inserted in a trie: each node computes its forward score once from the nodes above it,
and the count of pieces on the best path to a pre-token's last node is its token count, which the
worker remembers. Short pre-tokens make a trie of sorted rows, computed level by level with numpy;
long ones a linked trie. Documents add up the counts of their pre-tokens. Nothing is shuffled, and
every text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecspark.llm.arrow_text import slices, trimmed
from vecspark.llm.spm_model import UNKNOWN_PENALTY, SpmModel, distinct_pre_tokens

#: Nodes of the linked trie and remembered pre-tokens of a worker; beyond them it starts anew, which changes no count.
MAX_NODES = 200_000
MAX_WORDS = 150_000
#: Longest pre-token of the trie of sorted rows, and rows of one such trie.
MAX_LENGTH = 32
BATCH = 16_384


class ForwardTrie:
    """Forward scores and piece counts of every prefix inserted so far.

    ``scores`` are log-probabilities of pieces. A character that no piece consists of scores
    ``UNKNOWN_PENALTY`` below the worst piece and counts as its UTF-8 bytes. Of equal scores the
    segmentation whose last piece is longest wins.
    """

    def __init__(self, scores: dict[str, float], *, byte_fallback: bool = True):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best = [0.0]
        self.count = [0]

    def insert(self, word: str) -> int:
        """Insert a pre-token and return its token count."""
        child, best, count, scores, longest = self.child, self.best, self.count, self.scores, self.longest
        node, path = 0, [0]
        for i, ch in enumerate(word):
            key = node << 21 | ord(ch)
            node = child.get(key, 0)
            if not node:
                top, pieces = float("-inf"), 0
                for j in range(max(0, i + 1 - longest), i + 1):
                    s = scores.get(word[j : i + 1])
                    if s is not None and best[path[j]] + s > top:
                        top, pieces = best[path[j]] + s, count[path[j]] + 1
                if ch not in scores and best[path[i]] + self.unknown > top:
                    top = best[path[i]] + self.unknown
                    pieces = count[path[i]] + (len(ch.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1)
                node = len(best)
                child[key] = node
                best.append(top)
                count.append(pieces)
            path.append(node)
        return count[node]


class PieceTable:
    """Scores of pieces by a rolling hash of their characters, for arrays of substrings at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, scores: dict[str, float]):
        self.longest = max(map(len, scores), default=1)
        self.power = np.ones(max(self.longest, MAX_LENGTH) + 1, np.uint64)
        for i in range(1, len(self.power)):
            self.power[i : i + 1] = self.power[i - 1 : i] * self.BASE  # arrays wrap around in silence
        keys = np.array([self._hash(p) for p in scores], np.uint64)
        self.bits = max(8, int(len(scores) * 4).bit_length())
        values = np.fromiter(scores.values(), np.float64, len(scores))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        slot = self._slot(keys)
        _, one = np.unique(slot, return_index=True)
        rest = np.setdiff1d(np.arange(len(keys)), one)
        self.key, self.value = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -np.inf)
        self.key[slot[one]], self.value[slot[one]] = keys[one], values[one]
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[slot[rest]] = True
        self.rest_key, self.rest_value = np.append(keys[rest], ~np.uint64(0)), np.append(values[rest], -np.inf)

    def _hash(self, piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * int(self.BASE) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Scores, minus infinity where no piece has the hash."""
        at = self._slot(keys)
        hit = self.key[at] == keys
        out = np.where(hit, self.value[at], -np.inf)
        miss = np.flatnonzero(self.crowded[at] & ~hit)
        if len(miss):
            at = np.searchsorted(self.rest_key, keys[miss])
            at[at == len(self.rest_key)] = 0
            out[miss] = np.where(self.rest_key[at] == keys[miss], self.rest_value[at], -np.inf)
        return out


def sorted_trie_counts(words: list[str], table: PieceTable, unknown: float, byte_fallback: bool) -> np.ndarray:
    """Token counts of sorted distinct pre-tokens of up to ``MAX_LENGTH`` characters.

    Sorted, the pre-tokens are a trie: the prefix of i characters is a node of its own where it
    differs from the one of the row above, and otherwise the same node. Level by level the forward
    score of each node is computed once and handed to all rows that share it.
    """
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    width = int(size.max(initial=0))
    chars = np.array(words, f"U{max(1, width)}").view(np.uint32).reshape(n, -1)
    same = np.ones((n, width + 1), bool)
    same[0] = False
    if n > 1:
        np.logical_and.accumulate(chars[1:, :width] == chars[:-1, :width], axis=1, out=same[1:, 1:])
        same[1:, 1:] &= size[:-1, None] >= np.arange(1, width + 1)  # the filling of a shorter row is no character
    prefix = np.zeros((width + 1, n), np.uint64)
    for i in range(width):
        prefix[i + 1] = prefix[i] * table.BASE + chars[:, i] + np.uint64(1)
    best, count = np.zeros((width + 1, n)), np.zeros((width + 1, n), np.int32)
    row = np.arange(n)
    for i in range(1, width + 1):
        inside = size >= i
        node = np.flatnonzero(inside & ~same[:, i])
        top, pieces = np.full(len(node), -np.inf), np.zeros(len(node), np.int32)
        for length in range(min(i, table.longest), 0, -1):
            j = i - length
            score = table(prefix[i, node] - prefix[j, node] * table.power[length])
            value = best[j, node] + score
            better = value > top
            top[better], pieces[better] = value[better], count[j, node][better] + 1
            if length == 1:
                ch = chars[node, i - 1]
                value = best[j, node] + unknown
                better = np.isneginf(score) & (value > top)
                add = 1 + (ch > 0x7F) + (ch > 0x7FF) + (ch > 0xFFFF) if byte_fallback else np.ones(len(node), np.int32)
                top[better], pieces[better] = value[better], (count[j, node] + add)[better]
        holder = np.zeros(n, np.int64)
        holder[node] = node
        holder = np.maximum.accumulate(holder)
        best[i, node], count[i, node] = top, pieces
        best[i, inside], count[i, inside] = best[i, holder[inside]], count[i, holder[inside]]
    return count[size, row]


class TokenCounter:
    """Counts tokens of texts, with the counts of recent pre-tokens kept between calls."""

    def __init__(self, model: SpmModel):
        self.model = model
        self.trie = ForwardTrie(model.unigram_scores(), byte_fallback=model.byte_fallback)
        self.table = PieceTable(self.trie.scores)
        self.known: dict[str, int] = {"": 0}
        self.older: dict[str, int] = {}

    def _learn(self, new: list[str]) -> None:
        short = sorted(w for w in new if len(w) <= MAX_LENGTH)
        for i in range(0, len(short), BATCH):
            part = short[i : i + BATCH]
            self.known.update(zip(part, sorted_trie_counts(part, self.table, self.trie.unknown, self.trie.byte_fallback).tolist(), strict=True))
        for w in new:
            if len(w) > MAX_LENGTH:
                self.known[w] = self.trie.insert(w)
                if len(self.trie.best) > MAX_NODES:
                    self.trie.clear()

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Counts of an array of texts; -1 for null."""
        ends, at, words = distinct_pre_tokens(self.model, texts)
        known, older = self.known, self.older
        missing = set(words).difference(known)
        again = missing.intersection(older)
        known.update((w, older[w]) for w in again)
        self._learn(list(missing - again))
        each = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        stop = np.concatenate([[0], np.cumsum(each[at])])[ends]
        out = np.diff(stop, prepend=0)
        if texts.null_count:
            out[texts.is_null().to_numpy(zero_copy_only=False)] = -1
        if len(known) > MAX_WORDS:
            self.known, self.older = {"": 0}, known
        return out


_COUNTERS: dict[bytes, TokenCounter] = {}


def counter(raw: bytes) -> TokenCounter:
    key = sha1(raw).digest()
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(SpmModel.parse(raw))
    return _COUNTERS[key]


def token_counts(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (``id_col``, ``n_tokens``) for each row of ``df``.

    ``model`` is the content of a SentencePiece model file; it travels as a broadcast variable and
    its size doesn't depend on the data. A null text has a null count, an empty one 0. Very long texts
    are counted whole. Of equally good segmentations the one with the longest last piece counts, at
    each prefix. Repeated rows and null ids are counted row by row; other columns are not read, whatever
    their names. An empty table gives an empty table.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                n = count(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, mask=n < 0)], names=[id_col, "n_tokens"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(lambda batches: trimmed(run(batches)), schema)
