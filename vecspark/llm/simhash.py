"""Operator 4: near-duplicates by SimHash fingerprints, over all pairs or by multi-index hashing.

A document's features are all its distinct words, lower-cased and without punctuation at their ends.
Scripts that part no words by spaces (Han, kana, Thai, Lao, Burmese, Khmer) give their bigrams of
characters instead. Every feature counts alike: short words, numbers and negations as much as long
words. Signed sums of the features' random bits give a fingerprint of ``BITS`` bits, cut into segments
of 32 bits. The order of the words doesn't matter, nor how often each stands.

Search over all pairs (:func:`all_links`), the default: every two distinct fingerprints are compared, so
no pair within the threshold is left out. Fingerprints are spread over chunks and every two chunks meet in
a task of their own, which takes the distances in the first ``FIRST_BITS`` bits by matrix products, several
to each double, and the complete distance of the few pairs that are near in those. The work grows as the
square of the number of distinct fingerprints.

Search by tables (:func:`similar_links`), only with ``exact=False``: work in proportion to the fingerprints,
but some pairs within the threshold are left out. Each segment has its table. Two fingerprints whose
segments differ in two bits at most share a key when both enumerate the Hamming ball of radius one around
the segment. So every fingerprint enumerates that ball in each segment, equal keys in the segment's table
are matches, and the complete distance of each match is verified. Distances up to ``3 * SEGMENTS - 1`` are
found for certain, larger ones up to the threshold often. Tables are split in blocks by the key's leading bits,
whose number follows the number of fingerprints; a fingerprint goes to its own block with the ball's
members of that block, and to the blocks that one flipped leading bit leads to with that one member.
Blocks that stay large, since many fingerprints share the leading bits, are split in chunks, and every
two chunks meet in a task of their own; so no task holds an unbounded block, and no match is lost.

Equal fingerprints are searched once. Verified matches become groups by distributed connected
components; the smallest document of a group stays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.arrow_text import slices, trimmed
from vecspark.plans.session import cut, position, positional, prepare, release, small_or_hashed

SEGMENTS = 16
BITS = 32 * SEGMENTS
#: Complete distance up to which two fingerprints are near-duplicates.
MAX_DISTANCE = 92
#: Fingerprints that a block of a segment's table should hold.
BLOCK_ROWS = 250_000
#: Fingerprints of a block, in blocks' rows, from which on it is split in chunks.
HOT_BLOCKS = 4
#: Fingerprints of a block whose balls are enumerated at once, which bounds a task's memory.
PART_ROWS = 20_000
#: Bytes of text that are fingerprinted at once.
SLICE_BYTES = 1 << 19
#: Matches of one key up to which the distances of all pairs are taken at once; larger sets are searched
#: breadth first. Both give the same links.
PAIRWISE = 24
#: Leading bits whose distance is taken for all pairs; few are within the threshold in these and not in all.
FIRST_BITS = 256
#: Distances that one double holds in a product of matrices, and bits for each: at most 52 in all.
FIELDS, FIELD_BITS = 5, 10
#: Rows and columns of one product, and products that share their left side.
TILE_ROWS, TILE_COLUMNS, TILES = 1024, 512, 8
#: Verified pairs that are joined at once.
JOIN_ROWS = 1 << 12
#: Fingerprints that a chunk should hold for each root of their number, which balances what is shuffled with the
#: number of tasks, and at most, which bounds a task's memory.
CHUNK_ROOT, CHUNK_ROWS = 64, 262_144
_EDGE = "\"'.,;:!?()[]{}<>|%$#&*-_=+~`/\\«»„“”’‘…–—。、，！？；：（）「」『』《》【】"
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_RUN = re.compile(f"[{_UNSPACED}]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signs(words: list[bytes]) -> np.ndarray:
    """A row of ``BITS`` ones and minus ones for each word."""
    import xxhash

    base = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    step = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, BITS // 64 + 1, dtype=np.uint64)
    bits = np.unpackbits(_mix(base[:, None] + step[None, :]).view(np.uint8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def _bigrams(run: re.Match) -> str:
    r = run[0]
    return f" {' '.join([r[i : i + 2] for i in range(len(r) - 1)] or [r])} "


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as rows of bytes, and whether each text has one.

    A bit is set where more than half of the features have it. Null texts and those without a word
    have no fingerprint.
    """
    lower = pc.utf8_lower(texts.cast(pa.string()).fill_null(""))
    if pc.any(pc.match_substring_regex(lower, f"[{_UNSPACED}]")).as_py():
        lower = pa.array([_RUN.sub(_bigrams, t) for t in lower.to_pylist()], pa.string())
    lists = pc.utf8_split_whitespace(lower)
    n = len(lists)
    found = lists.flatten().dictionary_encode()
    words = pc.utf8_trim(found.dictionary, characters=_EDGE)
    merged = words.dictionary_encode()
    at = merged.indices.to_numpy(zero_copy_only=False).astype(np.int64)[found.indices.to_numpy(zero_copy_only=False)]
    filled = pc.not_equal(merged.dictionary, "").to_numpy(zero_copy_only=False)[at]
    doc = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    many = len(merged.dictionary) + 1
    key = np.unique(doc[filled] * many + at[filled])
    doc, at = key // many, key % many
    signs = _signs(pc.cast(merged.dictionary, pa.binary()).to_pylist()) if len(doc) else np.zeros((0, BITS), np.int8)
    out, has = np.zeros((n, BITS // 8), np.uint8), np.zeros(n, bool)
    if len(doc):
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        rows = doc[starts]
        ends = np.append(starts[1:], len(doc))
        for a, b, r in zip(starts.tolist(), ends.tolist(), rows.tolist(), strict=True):
            out[r] = np.packbits(signs[at[a:b]].sum(axis=0, dtype=np.int32) > 0)
        has[rows] = True
    return out, has


def _popcount(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(w[a] ^ w[b]).sum(axis=1, dtype=np.int64)


def _spanning(w: np.ndarray, rows: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect, within ``rows``, all that chains of verified pairs connect."""
    left, queue = rows, []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
            continue
        node = queue.pop()
        near = np.bitwise_count(w[left] ^ w[node]).sum(axis=1, dtype=np.int64) <= most
        found, left = left[near], left[~near]
        queue += found.tolist()
        yield np.full(len(found), node), found


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, the least row connected to each row, once the edges ``a``-``b`` connect more."""
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _links(prints: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For what the edges ``left``-``right`` connect: each row and the row of the least fingerprint connected to it."""
    rows, edge = np.unique(np.concatenate([left, right]), return_inverse=True)
    order = np.lexsort(prints[rows].view(">u8").reshape(len(rows), -1).T[::-1]) if len(rows) else rows
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    root = _joined(np.arange(len(rows)), rank[edge[: len(left)]], rank[edge[len(left) :]])
    place = rows[order]
    far = np.flatnonzero(root != np.arange(len(rows)))
    return place[root[far]], place[far]


def block_links(low: np.ndarray, own: np.ndarray, prints: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of one block, as two arrays of row numbers: of the least fingerprint of each
    set that chains of verified matches connect, and of each other one of the set.

    ``low``: the key's ``bits`` low bits; ``own``: rows that enumerate the ball in this block.
    """
    w = prints.view(np.uint64).reshape(len(prints), -1)
    split = min(bits, max(0, math.ceil(math.log2(max(1, len(low)) / PART_ROWS))))
    rest = bits - split
    low = low.astype(np.uint32)
    left, right = [], []
    for part in range(1 << split):
        keys, rows = [], []
        for mask in [0, *[1 << i for i in range(split)]]:
            at = np.flatnonzero((low >> np.uint32(rest)) ^ np.uint32(mask) == part) if split else np.arange(len(low))
            at = at[own[at]] if mask else at
            keys.append(low[at] & np.uint32((1 << rest) - 1))
            rows.append(at)
            if not mask:
                mine = at[own[at]]
                for i in range(rest):
                    keys.append((low[mine] & np.uint32((1 << rest) - 1)) ^ np.uint32(1 << i))
                    rows.append(mine)
        a, b = _part_edges(np.concatenate(keys).astype(np.uint64) << np.uint64(32) | np.concatenate(rows).astype(np.uint64), w, most)
        left += a
        right += b
    none = [np.zeros(0, np.int64)]
    return _links(prints, np.concatenate(left or none), np.concatenate(right or none))


def _part_edges(ball: np.ndarray, w: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Verified edges among keys, in the high half of ``ball``, of rows, in the low half."""
    ball.sort()
    key = (ball >> np.uint64(32)).astype(np.uint32)
    at = (ball & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    codes = []
    for k in np.unique(size[(size > 1) & (size <= PAIRWISE)]).tolist():
        runs = at[begin[size == k][:, None] + np.arange(k)[None, :]]
        a, b = np.triu_indices(k, 1)
        codes.append(np.unique((runs[:, a] << 32 | runs[:, b]).ravel()))
    code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    left, right = [], []
    for i in range(0, len(code), 1 << 18):
        a, b = code[i : i + (1 << 18)] >> 32, code[i : i + (1 << 18)] & 0xFFFFFFFF
        good = _popcount(w, a, b) <= most
        left.append(a[good])
        right.append(b[good])
    for s, k in zip(begin[size > PAIRWISE].tolist(), size[size > PAIRWISE].tolist(), strict=True):
        for a, b in _spanning(w, at[s : s + k], most):
            left.append(a)
            right.append(b)
    return left, right


def _left_side(prints: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(prints[:, : FIRST_BITS // 8], axis=1).astype(np.float64)
    return np.hstack([2 * bits - 1, -bits.sum(axis=1, keepdims=True), np.ones((len(bits), 1))])


def _right_side(prints: np.ndarray, most: int) -> np.ndarray:
    """The product with :func:`_left_side` has ``FIELDS`` fingerprints in each column. Its low 52 bits as an integer are
    fields whose highest bit tells that the distance is ``most`` or less: a field is half its range, plus ``most``,
    less the distance. All sums on the way are integers below ``2 ** 53``, hence exact in any order.
    """
    n = -(-len(prints) // FIELDS)
    bits = np.zeros((n * FIELDS, FIRST_BITS))
    bits[: len(prints)] = np.unpackbits(prints[:, : FIRST_BITS // 8], axis=1)
    scale = 2.0 ** (FIELD_BITS * np.arange(FIELDS))
    half = 1 << (FIELD_BITS - 1)
    full = 2.0**52 + (half + min(most, half - 1)) * scale.sum()
    return np.vstack([np.einsum("nfk,f->kn", bits.reshape(n, FIELDS, -1), scale), np.full((1, n), scale.sum()), np.full((1, n), full)])


def pair_links(prints: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as those of :func:`block_links`, that all pairs of a row of ``left`` and one of ``right`` within distance
    ``most`` give. Both may be the same array; its pairs are then taken once.
    """
    w = prints.view(np.uint64).reshape(len(prints), -1)
    top = [np.uint64(FIELD_BITS * (f + 1) - 1) for f in range(FIELDS)]
    flags = np.uint64(sum(1 << int(t) for t in top))
    root, near, waiting = np.arange(len(prints)), [], 0
    wide = TILE_COLUMNS * FIELDS
    for first in range(0, len(right), TILES * wide):
        sides = [(at, right[at : at + wide]) for at in range(first, min(first + TILES * wide, len(right)), wide)]
        sides = [(at, b, _right_side(prints[b], most)) for at, b in sides]
        for i in range(0, len(left), TILE_ROWS):
            if left is right and i >= first + TILES * wide:
                break
            a = left[i : i + TILE_ROWS]
            rows = _left_side(prints[a])
            for at, b, columns in sides:
                if left is right and i >= at + wide or (root[b] == root[a[0]]).all() and (root[a] == root[a[0]]).all():
                    continue
                product = rows @ columns
                fields = product.view(np.uint64)
                np.bitwise_and(fields, flags, out=fields)
                found = np.flatnonzero(fields != 0)
                value = fields.ravel()[found]
                for f in range(FIELDS):
                    hits = found[value >> top[f] & np.uint64(1) != 0]
                    x, y = hits // product.shape[1], hits % product.shape[1] * FIELDS + f
                    x, y = a[x[y < len(b)]], b[y[y < len(b)]]
                    for k in range(0, len(x), 1 << 18):
                        u, v = x[k : k + (1 << 18)], y[k : k + (1 << 18)]
                        apart = root[u] != root[v]
                        u, v = u[apart], v[apart]
                        good = _popcount(w, u, v) <= most
                        if good.any():
                            near.append((u[good], v[good]))
                            waiting += len(near[-1][0])
                        if waiting >= JOIN_ROWS:
                            root, near, waiting = _joined(root, *map(np.concatenate, zip(*near, strict=True))), [], 0
    if near:
        root = _joined(root, *map(np.concatenate, zip(*near, strict=True)))
    far = np.flatnonzero(root != np.arange(len(root)))
    return _links(prints, root[far], far)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Binary values of ``BITS // 8`` bytes, without nulls, as rows of bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.cast(pa.binary(BITS // 8))
    return np.frombuffer(flat.buffers()[1], np.uint8)[flat.offset * BITS // 8 :][: len(flat) * BITS // 8].reshape(-1, BITS // 8)


def fingerprint_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``id``, ``h``, ``fp``): the id, a hash of the text, and the fingerprint or null."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("h", T.LongType()), T.StructField("fp", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                prints, has = fingerprints(part.column("text"))
                fp = pc.if_else(pa.array(has), _binary(prints), pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), fp], names=["id", "h", "fp"])

    return df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("h"), df[text_col].alias("text")).mapInArrow(lambda batches: trimmed(run(batches)), schema)


def similar_links(prints: DataFrame, max_distance: int = MAX_DISTANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (``a``, ``b``) among distinct fingerprints, column ``fp`` of ``prints``, each counted row once.

    ``a`` is the least fingerprint that chains of matches within a block lead to from ``b``. What the
    links connect depends neither on blocks nor on the size of sets; there are fewer of them than
    fingerprints in a block, however many pairs are similar.
    """
    many = max(1, prints.count())
    high = min(24, max(0, math.ceil(math.log2(many / block_rows))))
    bits, most = 32 - high, HOT_BLOCKS * block_rows

    def blocks(fp: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Block and low bits of each fingerprint, for each segment and leading bit, and whether the block is its own."""
        segments = _rows(fp).view(">u4").astype(np.int64)
        for s in range(SEGMENTS):
            key = segments[:, s]
            for flip in [None, *range(high)]:
                top = (key >> bits) ^ (0 if flip is None else 1 << flip)
                yield (s << 24) | top, key & ((1 << bits) - 1), flip is None

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block, n = np.unique(np.concatenate([b for b, _, _ in blocks(batch.column("fp"))]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(n, pa.int64())], names=["block", "n"])

    chunks: dict[int, int] = {}
    if many > most:  # else no block can be larger
        large = prints.select("fp").mapInArrow(sizes, "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).where(F.col("n") > most)
        chunks = {r.block: math.ceil(r.n / (2 * block_rows)) for r in large.collect()}
    hot, parts = np.array(sorted(chunks), np.int64), np.array([chunks[b] for b in sorted(chunks)] + [1], np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                fp = whole.column("fp").slice(i, 4096)
                mixed = _mix(_rows(fp).view(np.uint64).reshape(len(fp), -1)[:, 0].copy())
                for block, low, own in blocks(fp):
                    at = np.searchsorted(hot, block)
                    m = parts[np.where(hot[np.minimum(at, len(hot) - 1)] == block, at, -1)] if len(hot) else np.ones(len(block), np.int64)
                    chunk = (mixed % m.astype(np.uint64)).astype(np.int64)
                    for other in range(int(m.max())):
                        rows = np.flatnonzero(m > other)
                        meet = np.minimum(chunk[rows], other) << 32 | np.maximum(chunk[rows], other)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(block[rows], pa.int32()), pa.array(meet), pa.array(low[rows]), pa.array(np.full(len(rows), own)), fp.take(pa.array(rows)) if len(rows) < len(fp) else fp],
                            names=["block", "chunks", "low", "own", "fp"],
                        )

    def match(t: pa.Table) -> pa.Table:
        a, b = block_links(t["low"].to_numpy(), t["own"].to_numpy(), rows := _rows(t["fp"]), bits, max_distance)
        return pa.table([_binary(rows[a]), _binary(rows[b])], names=["a", "b"])

    spreading = prints.select("fp").mapInArrow(lambda batches: trimmed(spread(batches)), "block int, chunks long, low long, own boolean, fp binary")
    return spreading.groupBy("block", "chunks").applyInArrow(match, "a binary, b binary").distinct()


def all_links(prints: DataFrame, max_distance: int = MAX_DISTANCE, chunk_rows: int | None = None) -> DataFrame:
    """Links (``a``, ``b``) as those of :func:`similar_links`, from all pairs of fingerprints within ``max_distance``.

    What the links connect depends on nothing else. Each fingerprint is shuffled once for each chunk of
    ``chunk_rows`` fingerprints; there is one partition for every two chunks.
    """
    many = max(1, prints.count())
    m = math.ceil(many / (chunk_rows or min(CHUNK_ROWS, CHUNK_ROOT * math.isqrt(many))))
    odd = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, BITS // 32, 2, dtype=np.uint64)

    def chunks(rows: np.ndarray) -> np.ndarray:
        return (_mix((rows.view(np.uint64).reshape(len(rows), -1) * odd).sum(axis=1, dtype=np.uint64)) % np.uint64(m)).astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                fp = whole.column("fp").slice(i, 4096)
                chunk = chunks(_rows(fp))
                for other in range(m):
                    low, high = np.minimum(chunk, other), np.maximum(chunk, other)
                    yield pa.RecordBatch.from_arrays([pa.array(low * m - low * (low - 1) // 2 + high - low, pa.int32()), fp], names=["pair", "fp"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_rows(batch.column("fp")) for batch in batches if batch.num_rows]
        if got:
            rows = np.concatenate(got)
            chunk = chunks(rows)
            left, right = np.flatnonzero(chunk == chunk.min()), np.flatnonzero(chunk == chunk.max())
            a, b = pair_links(rows, left, left if chunk.min() == chunk.max() else right, max_distance)
            for i in range(0, len(a), 4096):
                yield pa.RecordBatch.from_arrays([_binary(rows[a[i : i + 4096]]), _binary(rows[b[i : i + 4096]])], names=["a", "b"])

    pairs = prints.select("fp").mapInArrow(lambda batches: trimmed(spread(batches)), "pair int, fp binary").repartitionById(m * (m + 1) // 2, "pair")
    return pairs.mapInArrow(lambda batches: trimmed(match(batches)), "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (``node``, ``root``) for every node of ``edges`` (``a``, ``b``); the root is a component's least node.

    Alternating large-star and small-star steps; each round is written to the shared folder, so no
    lineage grows, and the number of rounds grows with the logarithm of the longest chain.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        step = cut(small.where("a <> b").distinct(), "edges")
        release(now)
        now, before = step, seen
        seen = state(now)
        if seen == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = cut(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "roots")
    release(now)
    return out


def _order(*columns: str) -> Column:
    """Ids in order with null last, then the text's hash."""
    return F.struct(F.col("id").isNull().alias("gone"), *[F.col(c) for c in columns])


def _groups(df: DataFrame, id_col: str, text_col: str, max_distance: int, exact: bool) -> DataFrame:
    """Rows (``id``, ``h``, ``group_id``, ``n_rows``, ``kept``, ``worded``), written to the shared folder."""
    prepare(df.sparkSession)
    table = cut(fingerprint_table(df, id_col, text_col), "prints")
    rows = table.groupBy("id", "h", "fp").agg(F.count("*").alias("n_rows"))
    single = cut(table.where("fp is not null").select("fp").distinct(), "distinct")
    links = cut((all_links if exact else similar_links)(single, max_distance), "links")
    release(single)
    roots = components(links)
    release(links)
    placed = rows.where("fp is not null").join(roots, F.col("fp") == F.col("node"), "left").select("id", "h", "n_rows", F.coalesce("root", "fp").alias("root"))
    first = placed.groupBy("root").agg(F.min(_order("id", "h")).alias("first"))
    grouped = placed.join(first, "root").select("id", "h", F.col("first.id").alias("group_id"), "n_rows", (_order("id", "h") == F.col("first")).alias("kept"), F.lit(True).alias("worded"))
    alone = rows.where("fp is null").select("id", "h", F.col("id").alias("group_id"), "n_rows", F.lit(True).alias("kept"), F.lit(False).alias("worded"))
    out = cut(grouped.union(alone), "groups")
    release(table, roots)
    return out


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, exact: bool = True) -> DataFrame:
    """Rows (``id_col``, ``h``, ``group_id``, ``n_rows``, ``kept``), one for each distinct id and text of ``df``.

    A group holds all that chains of pairs within ``max_distance`` connect; with ``exact=False`` pairs beyond
    distance 47 may be missed. ``group_id`` is the least id of the group, null only where all ids in it are; ``kept`` holds for
    exactly one row of each group: the one with the least id, and of those the least hash ``h`` of the
    text (``xxhash64``). ``n_rows`` counts the rows of ``df`` with this id and text. Rows with null,
    empty or wordless texts have no near-duplicates and are groups of their own. Null ids come last.
    Very long texts are fingerprinted whole. A bit that exactly half of the features have is 0. Columns
    other than the two are not read, whatever their names. An empty table gives an empty one.
    """
    return _groups(df, id_col, text_col, max_distance, exact).drop("worded").withColumnRenamed("id", id_col)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, exact: bool = True) -> DataFrame:
    """The rows of ``df`` with all their columns, one for each group of :func:`near_duplicate_groups`.

    Of rows that repeat id and text one stays, unless the text has no words: such rows all stay. Other
    columns may have any name, be repeated or hold dots.
    """
    rows, i, t = positional(df), position(df, id_col), position(df, text_col)
    groups = _groups(rows, i, t, max_distance, exact)
    gone = cut(groups.where(~F.col("kept")).select(F.col("id").alias("id"), "h"), "gone")
    many = cut(groups.where("kept and worded and n_rows > 1").select("id", "h"), "many")
    release(groups)

    def same(x: DataFrame) -> Column:
        return (F.xxhash64(rows[t]) == x["h"]) & rows[i].eqNullSafe(x["id"])

    out = rows.join(small_or_hashed(gone), same(gone), "left_anti")
    if not many.isEmpty():
        once = out.join(small_or_hashed(many), same(many), "left_semi").dropDuplicates([i, t])
        out = reduce(DataFrame.unionByName, [out.join(small_or_hashed(many), same(many), "left_anti"), once])
    return out.toDF(*df.columns)
