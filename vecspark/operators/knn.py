"""Exact nearest neighbours as DataFrame plans.

All searches return nearest first with ties by id, skip null vectors, cut vectors of different lengths to
the shorter, and give fewer rows where there are fewer than ``k``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.functions.distance import distance, distance_to
from vecspark.plans.session import cut, release, small_or_hashed
from vecspark.sources.options import metric as canonical

#: Queries that meet vectors in one task.
QUERY_BLOCK = 16_384
#: Vectors that a task of a batch search holds.
VECTOR_CHUNK = 65_536
#: Rows of queries and of vectors that are multiplied at once: 16 MB of distances.
TILE = (512, 4096)
#: Pairs of a query and a candidate that a task ranks at once, and bytes of a side of those whose exact distances it takes at once.
PAIRS, EXACT_BYTES = 1 << 16, 4 << 20


def knn(df: DataFrame, query: Sequence[float], k: int = 10, metric: str = "L2", id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """The ``k`` rows of ``df`` nearest to a vector, with ``distance``."""
    out = df.where(df[vec_col].isNotNull()).withColumn("distance", distance_to(F.col(vec_col), query, metric))
    return out.orderBy("distance", id_col).limit(k)


def knn_to_row(df: DataFrame, query: DataFrame, k: int = 10, metric: str = "L2", id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """As :func:`knn`, with the query vector from the single row and column of a DataFrame."""
    name = query.columns[0]
    one = query.select(F.col(name).alias("__q")).limit(1)
    joined = df.where(df[vec_col].isNotNull()).join(F.broadcast(one))
    return joined.withColumn("distance", distance(F.col(vec_col), F.col("__q"), metric)).drop("__q").orderBy("distance", id_col).limit(k)


def range_search(df: DataFrame, query: Sequence[float], radius: float, metric: str = "L2", vec_col: str = "vec") -> DataFrame:
    """Rows within a distance, with ``distance``; the plan is one filtered scan."""
    out = df.where(df[vec_col].isNotNull()).withColumn("distance", distance_to(F.col(vec_col), query, metric))
    return out.where(F.col("distance") <= radius)


def filtered_knn(df: DataFrame, query: Sequence[float], k: int, condition: Column, *, pre: bool, metric: str = "L2", id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """With ``pre`` the nearest rows among those that meet the condition, else the nearest rows that meet it."""
    if pre:
        return knn(df.where(condition), query, k, metric, id_col, vec_col)
    return knn(df, query, k, metric, id_col, vec_col).where(condition)


def group_knn(df: DataFrame, query: Sequence[float], k: int, group_col: str, metric: str = "L2", vec_col: str = "vec") -> DataFrame:
    """Groups (documents of several vectors) by their nearest member."""
    near = df.where(df[vec_col].isNotNull()).groupBy(group_col).agg(F.min(distance_to(F.col(vec_col), query, metric)).alias("distance"))
    return near.orderBy("distance", group_col).limit(k)


def _wide(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows as they are multiplied: in doubles, packed words as they are."""
    return x if metric == "HAMMING" else x.astype(np.float64)


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """All distances of two blocks of rows, in doubles, less a number for each row of ``q``; and those numbers."""
    if metric == "HAMMING":
        return sum((np.bitwise_count(q[:, i, None] ^ v[None, :, i]).astype(np.float64) for i in range(q.shape[1])), np.zeros((len(q), len(v)))), np.zeros(len(q))
    if metric == "L2":
        own = np.einsum("ij,ij->i", v, v)
        return np.hstack([-2 * q, np.ones((len(q), 1))]) @ np.hstack([v, own[:, None]]).T, np.einsum("ij,ij->i", q, q)
    if metric == "IP":
        return -q @ v.T, np.ones(len(q))
    d = q @ v.T
    norm = np.sqrt((q * q).sum(axis=1)[:, None] * (v * v).sum(axis=1)[None, :])
    np.divide(d, norm, out=d, where=norm != 0)
    d[norm == 0] = 0.0
    return np.negative(d, out=d), np.ones(len(q))


def _total(x: np.ndarray) -> np.ndarray:
    """Sums of rows, value by value as SQL adds them, so that what SQL finds equal is equal."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of equally many rows, pair by pair; what the block product rounds is exact here."""
    if metric == "L2":
        return _total((q - v) ** 2)
    if metric == "HAMMING":
        return np.bitwise_count(q ^ v).sum(axis=1).astype(np.float64)
    prod = _total(q * v)
    if metric == "IP":
        return 1.0 - prod
    norm = np.sqrt(_total(q * q) * _total(v * v))
    return np.where(norm == 0, 1.0, 1.0 - prod / np.where(norm == 0, 1.0, norm))


def _slack(q: np.ndarray, longest: float, metric: str) -> np.ndarray:
    """For each query twice what rounding can make of a distance of :func:`_distances`, generously; ``longest`` is the
    length of the longest vector."""
    if metric == "HAMMING":
        return np.zeros(len(q))
    eps = 8 * (q.shape[1] + 8) * np.finfo(np.float64).eps
    if metric == "COSINE":
        return np.full(len(q), eps)
    qn = np.sqrt((q * q).sum(axis=1))
    return eps * ((qn + longest) ** 2 if metric == "L2" else 1.0 + qn * longest)


def nearest(q: np.ndarray, v: np.ndarray, metric: str, k: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q``, rows of ``v`` and their distances: for each row of ``q`` the ``k`` nearest, ties by the row of ``v``.
    With ``order``, rows of ``v`` are counted in that order.

    Tiles are made doubles and multiplied; whatever may be among the nearest, after rounding and with all
    ties, gets its exact distance. The bound for that falls from tile to tile. Memory beside both sides is
    that of one tile and of what is kept.
    """
    order = np.arange(len(v)) if order is None else order
    tiles = [order[b : b + TILE[1]] for b in range(0, len(v), TILE[1])]
    longest = 0.0 if metric == "HAMMING" else np.sqrt(max((np.fmax.reduce((_wide(v[t], metric) ** 2).sum(axis=1), initial=0.0) for t in tiles), default=0.0))
    found = [_tile_rows(_wide(q[a : a + TILE[0]], metric), v, tiles, metric, k, a, longest) for a in range(0, len(q), TILE[0])]
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _tile_rows(q: np.ndarray, v: np.ndarray, tiles: list[np.ndarray], metric: str, k: int, offset: int, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    slack, bound = _slack(q, longest, metric), np.full(len(q), np.inf)
    row, col, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    step = max(1, EXACT_BYTES // (8 * max(1, q.shape[1])))
    for b, own in zip(range(0, len(v), TILE[1]), tiles, strict=True):
        tile = _wide(v[own], metric)
        d, more = _distances(q, tile, metric)
        near = ~(d > (bound - more)[:, None])  # what is no number counts as near
        if k < d.shape[1] and np.count_nonzero(near) > 2 * k * len(q):
            bound = np.fmin(bound, np.partition(d, k - 1, axis=1)[:, k - 1] + more + slack)
            near = ~(d > (bound - more)[:, None])
        x, y = np.nonzero(near)
        del d, near
        for i in range(0, len(x), PAIRS):
            r, c = x[i : i + PAIRS], y[i : i + PAIRS]
            new = [_exact(q[r[j : j + step]], tile[c[j : j + step]], metric) for j in range(0, len(r), step)]
            row, col, far = np.concatenate([row, r]), np.concatenate([col, c + b]), np.concatenate([far, *new])
            order = np.lexsort((col, far, row))
            row, col, far = row[order], col[order], far[order]
            first = np.searchsorted(row, np.arange(len(q)))
            place = np.arange(len(row)) - first[row]
            last = place == k - 1
            bound[row[last]] = np.fmin(bound[row[last]], far[last] + slack[row[last]])
            row, col, far = row[place < k], col[place < k], far[place < k]
    return row + offset, col, far


def _by_length(column: pa.Array | pa.ChunkedArray, kind: type | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of an array column without nulls: their numbers, and their values as a matrix, of the column's
    own kind where ``kind`` is None."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat if kind is None else flat.astype(kind, copy=False)
    start = np.cumsum(size) - size
    out = []
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        out.append((rows, flat.reshape(-1, n) if len(rows) == len(size) and n else flat[start[rows][:, None] + np.arange(n)[None, :]]))
    return out


def match(queries: pa.Table, vectors: pa.Table, metric: str, k: int) -> pa.Table:
    """Rows (``q``, ``id``, ``distance``): for each query (``q``, ``searchvec``) the ``k`` nearest of the vectors (``id``, ``vec``)."""
    kind = np.uint64 if metric == "HAMMING" else None  # signed numbers would be counted by their absolute values
    place = pc.sort_indices(vectors["id"], null_placement="at_start").to_numpy(zero_copy_only=False).astype(np.int64)
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    sides = _by_length(queries["searchvec"], kind), _by_length(vectors["vec"], kind)
    found = []
    for qrows, q in sides[0]:
        for vrows, v in sides[1]:
            n = min(q.shape[1], v.shape[1])
            order = np.argsort(rank[vrows])
            r, c, d = nearest(q[:, :n], v[:, :n], metric, k, order)
            found.append((qrows[r], rank[vrows[order[c]]], d))
    row, col, far = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    if len(found) > 1:
        order = np.lexsort((col, far, row))
        row, col, far = row[order], col[order], far[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col, far = row[keep], col[keep], far[keep]
    return pa.table([queries["q"].take(pa.array(row)), vectors["id"].take(pa.array(place[col])), pa.array(far)], names=["q", "id", "distance"])


def ranked(found: DataFrame, k: int, query_id: str, id_col: str) -> DataFrame:
    """The ``k`` nearest of each query from rows (``q``, ``id``, ``distance``), of which several may tell the same."""
    rank = F.dense_rank().over(Window.partitionBy("q").orderBy("distance", "id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k).dropDuplicates(["q", "rank"])
    return out.select(F.col("q").alias(query_id), "rank", F.col("id").alias(id_col), "distance")


def batch_schema(queries: DataFrame, query_id: str, id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("q", queries.schema[query_id].dataType), T.StructField("id", id_type), T.StructField("distance", T.DoubleType())])


def knn_batch(df: DataFrame, queries: DataFrame, k: int = 10, metric: str = "L2", id_col: str = "id", vec_col: str = "vec", query_id: str = "qid", query_vec: str = "searchvec", block: int = QUERY_BLOCK, chunk: int = VECTOR_CHUNK) -> DataFrame:
    """Rows (``query_id``, ``rank`` from 1, ``id_col``, ``distance``) for each query.

    Up to ``block`` queries are broadcast, and each task multiplies the vectors it scans with them: no
    vector is shuffled. More queries are put in blocks and the vectors in chunks by hash, and each block
    meets each chunk in a task of one plan. Either way a task keeps the ``k`` nearest of each query, ties
    by id however many there are, and a window over those survivors gives the result. Queries with one
    id are one query of several vectors; a vector's id counts once for it.
    """
    m = canonical(metric)
    vectors = df.where(df[vec_col].isNotNull()).select(df[id_col].alias("id"), df[vec_col].alias("vec"))
    asked = queries.where(queries[query_vec].isNotNull()).select(queries[query_id].alias("q"), queries[query_vec].alias("searchvec"))
    return ranked(_survivors(vectors, asked, k, m, block, chunk), k, query_id, id_col)


def _survivors(vectors: DataFrame, asked: DataFrame, k: int, m: str, block: int = QUERY_BLOCK, chunk: int = VECTOR_CHUNK) -> DataFrame:
    """Rows (``q``, ``id``, ``distance``), with the ``k`` nearest of the vectors (``id``, ``vec``) for each query (``q``, ``searchvec``)."""
    schema = batch_schema(asked, "q", vectors.schema["id"].dataType)
    few = asked.limit(block + 1).toArrow()
    if len(few) <= block:
        shared = vectors.sparkSession.sparkContext.broadcast(few)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, best = [], None
            for b in batches:
                held.append(b)
                if sum(x.num_rows for x in held) >= chunk:
                    best = merge(best, match(shared.value, pa.Table.from_batches(held), m, k))
                    held = []
            if held:
                best = merge(best, match(shared.value, pa.Table.from_batches(held), m, k))
            if best is not None:
                yield from best.to_batches()

        def merge(best: pa.Table | None, new: pa.Table) -> pa.Table:
            return new if best is None else _top(pa.concat_tables([best, new]), k)

        return vectors.mapInArrow(scan, schema)
    blocks, chunks = -(-asked.count() // block), max(1, -(-vectors.count() // chunk))
    meet = lambda own, n, other, many: [F.pmod(F.xxhash64(*own), F.lit(n)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("other")]
    left = asked.select("*", *meet(["q", "searchvec"], blocks, "chunk", chunks)).withColumnsRenamed({"own": "block", "other": "chunk"})
    right = vectors.select("*", *meet(["id", "vec"], chunks, "block", blocks)).withColumnsRenamed({"own": "chunk", "other": "block"})
    both = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    return both.applyInArrow(lambda q, v: match(q, v, m, k), schema)


def knn_lateral(df: DataFrame, queries: DataFrame, k: int = 10, metric: str = "L2", id_col: str = "id", vec_col: str = "vec", query_vec: str = "searchvec", block: int = QUERY_BLOCK, chunk: int = VECTOR_CHUNK) -> DataFrame:
    """Rows (``searchvec``, ``id``, ``distance``) for each distinct query vector, null included: what a lateral subquery
    with ``ORDER BY distance, id LIMIT k`` gives.

    As there a null vector has a null distance, and nulls come first; rows with one id all count. The rows
    are written, by one batch search.
    """
    asked = cut(queries.select(queries[query_vec].alias("searchvec")).distinct().withColumn("q", F.monotonically_increasing_id()), "asked")
    rows = df.select(df[id_col].alias("id"), df[vec_col].alias("vec"))
    none = F.lit(None).cast("double").alias("distance")
    found = _survivors(rows.where("vec is not null"), asked.where("searchvec is not null"), k, canonical(metric), block, chunk)
    for lost, hit in ((rows.where("vec is null"), asked.where("searchvec is not null")), (rows, asked.where("searchvec is null"))):
        if not hit.isEmpty():
            found = found.unionByName(hit.select("q").join(F.broadcast(lost.orderBy("id").limit(k)), how="cross").select("q", "id", none))
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    near = found.withColumn("place", place).where(F.col("place") <= k)
    out = cut(near.join(small_or_hashed(asked), "q").select("searchvec", "id", "distance"), "lateral")
    release(asked)
    return out


def _top(t: pa.Table, k: int) -> pa.Table:
    t = t.sort_by("id", null_placement="at_start").sort_by([("q", "ascending"), ("distance", "ascending")])  # sorts are stable
    q = t["q"].combine_chunks().dictionary_encode()
    q = (q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q).indices.fill_null(-1).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.diff(q, prepend=-2))
    return t.filter(pa.array(np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k))


def neighbours_union(df: DataFrame, queries: DataFrame, k: int = 10, metric: str = "L2", id_col: str = "id", vec_col: str = "vec", query_id: str = "qid", query_vec: str = "searchvec") -> DataFrame:
    """Rows of ``df`` that are a neighbour of any query."""
    near = knn_batch(df, queries, k, metric, id_col, vec_col, query_id, query_vec).select(F.col(id_col).alias("__near")).distinct()
    return df.join(near, df[id_col] == F.col("__near"), "left_semi")


#: Distance of a row that the search didn't return.
NO_DISTANCE = 99999999999.99


def row_distance(df: DataFrame, neighbours: DataFrame, id_col: str = "id") -> DataFrame:
    """``df`` with ``row_distance``: the neighbour's distance, or ``NO_DISTANCE`` for other rows."""
    near = neighbours.select(F.col(id_col).alias("__near"), F.col("distance").alias("__d"))
    joined = df.join(near, df[id_col] == F.col("__near"), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce("__d", F.lit(NO_DISTANCE)).alias("row_distance"))


def ann_set(neighbours: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: the ids from near to far as JSON text, in ``ids``."""
    ordered = F.array_sort(F.collect_list(F.struct("distance", id_col)))
    return neighbours.agg(F.to_json(F.transform(ordered, lambda s: s[id_col])).alias("ids"))
