import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecspark.operators import knn as K
from vecspark.operators.hnsw import Graph
from vecspark.operators.index import CHUNK_BYTES, VectorIndex
from vecspark.plans.session import scratch_path


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist(), i % 5) for i, x in enumerate(v)] + [(999, None, 1)], "id long, vec array<float>, label int").cache()
    return v.astype(float), df


def brute(v, q, metric):
    if metric == "L2":
        return ((v - q) ** 2).sum(axis=1)
    d = 1 - v @ q
    return d if metric == "IP" else 1 - (v @ q) / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))


@pytest.mark.parametrize("metric", ["L2", "IP", "COSINE"])
def test_single_and_batch(spark, data, metric):
    v, df = data
    queries = df.where("id < 12").select(F.col("id").alias("qid"), F.col("vec").alias("searchvec"))
    got = {}
    for r in K.knn_batch(df, queries, 6, metric, block=5).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id))
    for i in range(12):
        want = np.lexsort((np.arange(len(v)), np.round(brute(v, v[i], metric), 9)))[:6].tolist()
        assert [x for _, x in sorted(got[i])] == want
        assert [r.id for r in K.knn(df, v[i].tolist(), 6, metric).collect()] == want
    assert [r.id for r in K.knn_to_row(df, df.where("id = 3").select("vec"), 2).collect()] == [3, 7]


@pytest.mark.parametrize("metric", ["L2", "IP", "COSINE", "HAMMING"])
def test_batch_ties_by_id(spark, metric):
    rng = np.random.default_rng(5)
    n, k = 600, 5
    v = rng.integers(0, 4, size=(n, 2)) if metric == "HAMMING" else rng.normal(size=(n, 16)).astype(np.float32)
    v[rng.choice(n, 60, replace=False)] = v[0]
    ids = rng.permutation(n)
    kind = "bigint" if metric == "HAMMING" else "float"
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], f"id long, vec array<{kind}>").coalesce(1)
    got = {}
    for r in K.knn_batch(df, df.select(F.col("id").alias("qid"), F.col("vec").alias("searchvec")), k, metric).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id))
    for q, x in zip(ids.tolist(), v, strict=True):
        d = np.bitwise_count(v ^ x).sum(axis=1) if metric == "HAMMING" else brute(v.astype(float), x.astype(float), metric)
        want = ids[np.lexsort((ids, np.round(d.astype(float), 9)))[:k]].tolist()
        assert [i for _, i in sorted(got[q])] == want


def test_edges(spark, data):
    v, df = data
    q = v[0].tolist()
    assert K.knn(df, q, 1000).count() == 300
    none = df.where("id < 0")
    assert K.knn(none, q, 3).count() == 0
    queries = df.select(F.col("id").alias("qid"), F.col("vec").alias("searchvec"))
    assert K.knn_batch(none, queries, 3).count() == 0
    assert K.knn_batch(df, queries.where("qid < 0"), 3).count() == 0
    assert K.knn_batch(df, queries.where("qid = 999"), 3).count() == 0
    assert K.knn_batch(df.where("id < 4"), queries.where("qid = 1"), 9).count() == 4


def test_filters_groups_ranges(data):
    v, df = data
    q, d = v[0].tolist(), brute(v, v[0], "L2")
    order = np.argsort(d, kind="stable")
    assert {r.id for r in K.filtered_knn(df, q, 20, F.col("label") == 3, pre=True).collect()} == {i for i in order if i % 5 == 3 and i in order[np.flatnonzero(order % 5 == 3)[:20]]}
    assert {r.id for r in K.filtered_knn(df, q, 20, F.col("label") == 3, pre=False).collect()} == {i for i in order[:20] if i % 5 == 3}
    assert {r.id for r in K.range_search(df, q, 15.0).collect()} == set(np.flatnonzero(d <= 15).tolist())
    assert [r.label for r in K.group_knn(df, q, 3, "label").collect()] == sorted(range(5), key=lambda g: d[g::5].min())[:3]
    near = K.knn(df, q, 3)
    assert K.ann_set(near).first().ids == "[" + ",".join(map(str, order[:3].tolist())) + "]"
    far = {r.id: r.row_distance for r in K.row_distance(df, near).collect()}
    assert far[0] == 0 and far[999] == K.NO_DISTANCE and len(far) == 301


@pytest.mark.parametrize(("block", "chunk"), [(4, 50), (4, 1000), (1000, 50), (1000, 1000)])
def test_blocks_and_chunks_change_nothing(spark, data, monkeypatch, block, chunk):
    v, df = data
    monkeypatch.setattr(K, "TILE", (7, 16))
    monkeypatch.setattr(K, "PAIRS", 64)
    queries = df.where("id < 20").select(F.col("id").alias("qid"), F.col("vec").alias("searchvec"))
    got = {}
    for r in K.knn_batch(df, queries, 6, block=block, chunk=chunk).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id))
    for i in range(20):
        assert [x for _, x in sorted(got[i])] == np.lexsort((np.arange(len(v)), np.round(brute(v, v[i], "L2"), 9)))[:6].tolist()


@pytest.mark.parametrize("block", [3, 1000])
def test_many_equal_and_ragged_vectors(spark, block):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "id long, vec array<float>")
    ask = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(4)], "qid long, searchvec array<float>")
    assert sorted({r.id for r in K.knn_batch(same, ask, 5, block=block).collect()}) == [0, 1, 2, 3, 4]
    rng = np.random.default_rng(2)
    ragged = [(i, rng.normal(size=rng.integers(0, 5)).astype(np.float32).tolist()) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(ragged, "id long, vec array<float>")
    for metric in ("L2", "IP", "COSINE"):
        got = {}
        for r in K.knn_batch(df, df.selectExpr("id AS qid", "vec AS searchvec"), 4, metric, block=block).collect():
            got.setdefault(r.qid, []).append((r.rank, r.id, round(r.distance, 6)))
        for i, q in ragged[:-1]:
            assert [(x, d) for _, x, d in sorted(got[i])] == [(r.id, round(r.distance, 6)) for r in K.knn(df, q, 4, metric).collect()], (metric, i)


def test_hamming_of_all_bits(spark):
    rng = np.random.default_rng(8)
    w = rng.integers(-(2**63), 2**63 - 1, (40, 2))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(w.tolist())], "id long, vec array<bigint>")
    d = np.bitwise_count((w[:, None, :] ^ w[None, :, :]).view(np.uint64)).sum(axis=2)
    for r in K.knn_batch(df, df.selectExpr("id AS qid", "vec AS searchvec"), 40, "HAMMING").collect():
        assert r.distance == d[r.qid, r.id]
    assert [(r.id, r.distance) for r in K.knn(df, w[0].tolist(), 40, "HAMMING").collect()] == sorted(((i, x) for i, x in enumerate(d[0].tolist())), key=lambda t: (t[1], t[0]))


def test_graph_recall_and_round_trip():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(6000, 16)).astype(np.float32)
    for metric in ("L2", "COSINE"):
        g = Graph.load(Graph(16, metric, 8, 60).build(np.arange(len(v)) + 7, v).dump(), metric)
        assert g.faults() == []
        row, found, far = g.search(v[:100], 10, 80)
        assert (np.bincount(row) == 10).all() and (np.diff(far)[np.diff(row) == 0] >= 0).all()
        want = {(q, i + 7) for q in range(100) for i in np.argsort(brute(v.astype(float), v[q].astype(float), metric))[:10].tolist()}
        got = set(zip(row.tolist(), found.tolist(), strict=True))
        assert len(want & got) >= 0.95 * len(want)
        assert g.evaluated.mean() < 0.2 * len(v)  # it isn't a scan
        gone = np.array([i for q, i in want if q < 50])
        row, found, _ = g.search(v[:100], 10, 80, gone)
        assert not set(found.tolist()) & set(gone.tolist()) and (np.bincount(row) == 10).all()
    assert [len(x) for x in Graph(16).search(v[:1], 3, 10)] == [0, 0, 0]
    one = Graph(16).build(np.array([5]), v[:1])
    assert one.search(v[:2], 3, 10)[1].tolist() == [5, 5]
    words = rng.integers(-(2**62), 2**62, (300, 2))
    g = Graph.load(Graph(128, "HAMMING", 8, 60).build(np.arange(300), words).dump(), "HAMMING")
    row, found, far = g.search(words[:20], 5, 300)
    for q in range(20):
        d = np.bitwise_count((words ^ words[q]).view(np.uint64)).sum(axis=1)
        assert far[row == q].tolist() == np.sort(d)[:5].tolist() == d[found[row == q]].tolist()
    bad = Graph(16, "L2", 4, 20).build(np.arange(50), v[:50])
    bad.near[0][3, 0] = 3
    assert any("itself" in x for x in bad.faults())


@pytest.mark.parametrize("metric", ["L2", "IP", "COSINE"])
def test_a_match_holds_one_tile(metric):
    """What numpy holds of 20,000 vectors (5 MB) and 2,048 queries: a tile's distances and little else."""
    rng = np.random.default_rng(6)
    rows = lambda n: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 64, pa.int32()), pa.array(rng.normal(size=n * 64).astype(np.float32)))
    q, v = (pa.table([pa.array(np.arange(n)), rows(n)], names=names) for n, names in ((2048, ["q", "searchvec"]), (20_000, ["id", "vec"])))
    tracemalloc.start()
    try:
        assert K.match(q, v, metric, 5).num_rows == 5 * 2048
        assert tracemalloc.get_traced_memory()[1] < 70e6
    finally:
        tracemalloc.stop()


def test_chunks_of_lists_are_bounded_in_bytes(spark):
    for dim in (2, 64, 1024, 4096):
        index = VectorIndex(spark, scratch_path(spark, "idx"), "t.v", f"type=IVF,dim={dim}")
        assert 1 <= index.chunk_rows <= K.VECTOR_CHUNK and 4 * dim * index.chunk_rows <= CHUNK_BYTES


def test_vectors_that_are_no_numbers_hide_none(monkeypatch):
    monkeypatch.setattr(K, "TILE", (4, 8))
    rng = np.random.default_rng(9)
    v = rng.normal(size=(60, 3)) * 1e3
    v[5], v[11] = np.nan, np.inf
    for metric in ("L2", "IP"):
        row, col, _ = K.nearest(v[:1], v, metric, 4, np.random.default_rng(1).permutation(60))
        order = np.random.default_rng(1).permutation(60)
        d = K._exact(np.repeat(v[:1], 60, axis=0), v[order], metric)
        assert col.tolist() == np.lexsort((np.arange(60), d))[:4].tolist()
