from datetime import datetime, timezone
from functools import partial

import numpy as np
import pytest

from vecspark.engine import Engine, EngineError
from vecspark.operators.index import IndexError_, VectorIndex
from vecspark.operators.knn import knn_lateral
from vecspark.plans import rewrite as R
from vecspark.plans.session import scratch_path
from vecspark.sources.versions import VersionConflict, Versions
from vecspark.streaming.cdc import CdcDisabled


@pytest.fixture
def engine(spark):
    return Engine(spark, scratch_path(spark, "idx"))


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(250)], "id long, vec array<float>").cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_rewriting_rules():
    view = lambda *a: "near" + str(len(a[3] or ""))
    q = "SELECT * FROM t WHERE OurVector_Is_Ann('d.t.c', 'id', vec_construct('[1,2]'), 'nn=3') AND note = 'VECTOR_IS_ANN(1,2,3)'"
    assert R.rewrite_is_ann(q, view) == "SELECT * FROM t WHERE (id IN (SELECT near_id FROM near4)) AND note = 'VECTOR_IS_ANN(1,2,3)'"
    for same in ("SELECT VECTOR_IS_ANN('a','b')", "SELECT VECTOR_IS_ANN('a','b',(c)", "SELECT VECTOR_IS_ANN(a,b,c,d,e)"):
        assert R.rewrite_is_ann(same, view) == same
    assert R.rewrite_search("SELECT * FROM VECTOR_SEARCH{d.t, id, d.t.c, q, nn=5}", view) == "SELECT * FROM d.t WHERE id IN (SELECT near_id FROM near4)"
    for same in ("SELECT * FROM VECTOR_SEARCH[a,b,c]", "SELECT * FROM VECTOR_SEARCH(a,b,c,d)", "SELECT * FROM VECTOR_SEARCH[a,b,c,d,e,f]"):
        assert R.rewrite_search(same, view) == same
    assert R.rewrite_columns("CREATE TABLE t(v VECTOR(dim=3,track=upd), w vector(dim=4))") == "CREATE TABLE t(v ARRAY<FLOAT> COMMENT 'VECTOR Column |type=KNN,dim=3,track=upd', upd TIMESTAMP, w ARRAY<FLOAT> COMMENT 'VECTOR Column |type=KNN,dim=4')"
    for same in ("CREATE TABLE t(v VECTOR(type=KNN))", "CREATE TABLE t(v VECTOR(dim=1))", "CREATE TABLE t(v INT COMMENT 'VECTOR(dim=3)')", "CREATE TABLE t(v VECTOR(dim=3,x))"):
        assert R.rewrite_columns(same) == same
    assert R.parse_call("CALL tools.VECTOR_INDEX_BUILD('d.t.c', 'id');") == ("build", ["d.t.c", "id"])
    assert R.parse_call("CALL other('x')") is None


def test_names_in_quotes_stay(spark, engine):
    r = engine.sql("SELECT 'vector_distance(' AS s, 1 AS vector_distance, ourvector_distance(array(1f), array(3f)) AS d -- vector_dot(1)")
    assert r.columns == ["s", "vector_distance", "d"] and tuple(r.first()) == ("vector_distance(", 1, 4.0)
    assert engine.sql("SELECT vector_construct('[1,2]', 'i=string,o=float') AS a, vector_display(array(1f, 2.5f)) AS b").first() == ([1.0, 2.0], "[1, 2.5]")
    with pytest.raises(ValueError, match="told"):
        engine.sql("SELECT vector_construct('[1]', 'i=string,o=words')")


def test_sets_and_online_columns(spark, engine, rows, tmp_path):
    engine.add_index("t.s", "type=KNN,dim=64").build(rows)
    q = rows.where("id = 9").first().vec
    said = engine.sql(f"SELECT vector_ann_set('t.s', 'id', array({','.join(map(str, q))}), 3) AS ids, vector_ann_set('t.s', 'id', CAST(NULL AS ARRAY<FLOAT>)) AS none").first()
    assert said.ids.startswith("[9,") and said.none is None
    sets = {r.qid: r.ids for r in engine.ann_sets("t.s", rows.where("id < 3").selectExpr("id AS qid", "vec AS searchvec"), 2).collect()}
    assert len(sets) == 3 and all(v.startswith(f"[{k},") for k, v in sets.items())
    spark.sql("DROP TABLE IF EXISTS on_t")
    engine.sql("CREATE TABLE on_t (id BIGINT, a VECTOR(dim=2,online=Y,idcol=id), b VECTOR(dim=2)) USING parquet")
    schema = "op string, id long, vec array<float>, seq long"
    spark.createDataFrame([("I", 1, [1.0, 2.0], 1)], schema).write.parquet(str(tmp_path / "feed"))
    stream = lambda name: spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
    started = engine.start_online(stream, str(tmp_path / "check"), available_now=True)
    assert list(started) == ["default.on_t.a"]
    started["default.on_t.a"].awaitTermination()
    assert ids(engine.index("default.on_t.a").vectors()) == [1] and engine.start_online(stream, str(tmp_path / "check")) == {}
    spark.sql("DROP TABLE on_t")
    with pytest.raises(CdcDisabled):
        Engine(spark, engine.index_dir, feature_level=3).start_stream("x", None, "y")


def test_dead_writers_are_swept(spark):
    v = Versions(spark, scratch_path(spark, "v"))
    live = v.fresh()
    for f in (live, v.fresh()):
        spark.range(1).write.parquet(f)
    v.commit({"parent": 0, "folders": [live]})
    assert v.sweep() == [] and len(v.sweep(grace=-60)) == 1 and spark.read.parquet(live).count() == 1


def test_procedures_and_annotations(spark, engine):
    spark.sql("DROP TABLE IF EXISTS words_t")
    engine.sql("CREATE TABLE words_t (c1 BIGINT, note STRING, vec VECTOR(dim=3,track=upd)) USING parquet")
    spark.sql("INSERT INTO words_t VALUES (1, 'a', array(1.1f,2.2f,3.3f), current_timestamp()), (2, 'b', array(2.2f,3.3f,4.4f), current_timestamp()), (3, 'c', array(3.3f,4.4f,5.5f), current_timestamp())")
    assert [tuple(r) for r in engine.vector_columns().collect() if r.tbl == "words_t"] == [("default", "words_t", "vec", "type=KNN,dim=3,track=upd")]
    name = "default.words_t.vec"
    with pytest.raises(EngineError, match="not open"):
        engine.sql(f"SELECT * FROM words_t WHERE VECTOR_IS_ANN('{name}','c1',array(1f,2f,3f))")
    assert "rows: 3" in engine.sql(f"CALL vector_index_build('{name}', 'c1')").first().status
    q = f"SELECT c1, vector_row_distance(c1) AS d FROM words_t WHERE VECTOR_IS_ANN('{name}', 'c1', vector_construct('[1.0, 2.0, 3.0]'), 2) ORDER BY d"
    assert [(r.c1, round(r.d, 2)) for r in engine.sql(q).collect()] == [(1, 0.14), (2, 5.09)]
    assert engine.sql(q.replace("vector_construct('[1.0, 2.0, 3.0]')", "CAST(NULL AS ARRAY<FLOAT>)")).count() == 0
    assert engine.sql(f"EXPLAIN SELECT * FROM words_t WHERE VECTOR_IS_ANN('{name}','c1',array(1f,2f,3f))").count() == 1
    spark.sql("INSERT INTO words_t VALUES (4, 'd', array(1f,2f,3f), current_timestamp())")
    assert "rows: 4" in engine.sql(f"CALL vector_index_refresh('{name}', 'c1')").first().status
    assert engine.sql(q).first().c1 == 4
    assert engine.sql(f"CALL vector_index_status('{name}')").first().n_rows == 4
    assert engine.sql(f"CALL vector_index_save('{name}')").first().status.startswith("SUCCESS")
    again = Engine(spark, engine.index_dir, prefix="my_")
    again.sql(f"CALL vector_index_load('{name}')")
    assert again.sql(q).first().c1 == 4
    assert spark.sql("SELECT my_distance(array(1f), array(3f))").first()[0] == 4
    engine.sql(f"CALL vector_index_drop('{name}')")
    for bad in (f"CALL vector_index_status('{name}')", f"CALL vector_index_build('{name}')", "CALL vector_index_build('default.words_t.note','c1')", "CALL vector_index_build('nowhere.c','c1')"):
        with pytest.raises(EngineError):
            engine.sql(bad)
    spark.sql("DROP TABLE words_t")


@pytest.mark.parametrize("options", ["type=KNN,dim=64", "type=IVF,dim=64,nlist=8,ef_search=8", "type=HNSW,dim=64,M=8,ef=80", "type=HNSW,dim=64,dist=cosine,ef=80", "type=IVF,dim=64,nlist=8,ef_search=8,dist=IP"])
def test_index_types(spark, engine, rows, options):
    index = engine.add_index("t.c", options)
    if "HNSW" in options:
        index.shard_rows = 100
    index.build(rows.unionByName(rows.where("id < 5")))
    assert index.manifest["rows"] == 250
    from vecspark.operators.knn import knn_batch

    queries = rows.where("id < 20").selectExpr("id AS qid", "vec AS searchvec")
    want = {(r.qid, r.id) for r in knn_batch(rows, queries, 5, index.options.dist).collect()}
    got = {(r.qid, r.id) for r in index.search_batch(queries, 5, 80 if "HNSW" in options else 8).collect()}
    assert len(want & got) >= (0.9 if "HNSW" in options else 1) * len(want)
    assert index.search(rows.where("id = 3").first().vec, 1).first().id == 3 or "IP" in options
    index.delete(rows.where("id = 3").select("id"))
    assert "delta" in index.manifest["parts"] and index.manifest["rows"] == 249 and index.integrity().count() == 0
    base = index.manifest["parts"]["base"]
    new = rows.where("id in (5, 6, 5000)").unionByName(rows.where("id = 7").selectExpr("5000L AS id", "vec"))
    index.upsert(new.selectExpr("id", "transform(vec, x -> x * 2) AS vec", "vec[0] AS o"), "o")
    assert index.manifest["rows"] == 250 and index.vector(6) == [x * 2 for x in rows.where("id = 6").first().vec] and index.vector(3) is None
    assert index.manifest["parts"]["base"] == base and (5000 in ids(index.search(index.vector(5000), 2)) or "IP" in options)
    index.delete(index.vectors().where("id = 5000").select("id"))
    assert 3 not in ids(index.search(rows.where("id = 3").first().vec, 5))
    assert VectorIndex(spark, engine.index_dir, "t.c", options).load().vectors().count() == 249
    index.upsert(rows.where("id >= 100"))  # more than the delta may hold: a new base
    assert "delta" not in index.manifest["parts"] and index.manifest["rows"] == 249 and index.vectors().count() == 249 and index.integrity().count() == 0
    index.build(rows.where("id < 0"))
    assert index.search([0.0] * 64, 5).count() == 0
    index.upsert(rows.where("id < 2").unionByName(rows.where("id = 1")))
    assert index.manifest["rows"] == 2 and len(ids(index.search([0.0] * 64, 5))) == 2


def test_binary_graph_and_capacity(engine, rows):
    index = engine.add_index("t.b", "type=HNSW_BV,dim=64,ef=80")
    index.build(rows)
    assert index.search(rows.where("id = 9").first().vec, 1).first().id == 9
    with pytest.raises(IndexError_, match="exceed"):
        engine.add_index("t.s", "type=HNSW,dim=64,size=10").build(rows)


def test_versions_conflict(spark):
    v = Versions(spark, scratch_path(spark, "v"))
    assert v.latest() is None
    v.commit({"parent": 0, "folders": []})
    with pytest.raises(VersionConflict):
        v.commit({"parent": 0, "folders": []})
    assert v.latest()["version"] == 1


def test_changes(spark, engine, tmp_path):
    index = engine.add_index("t.e", "type=KNN,dim=3,online=Y")
    index.load()
    schema = "op string, id long, vec array<float>, seq long"
    feed, check = str(tmp_path / "feed"), str(tmp_path / "check")
    one = [("I", i, [i * 1.1, i * 1.1 + 1.1, i * 1.1 + 2.2], i) for i in (1, 2, 3)] + [("I", 4, [0.0, 0.0, 0.0], 4), ("U", 4, [9.9, 9.9, 9.9], 5), ("I", None, [1.0], 6), ("D", 77, None, 7)]

    def more(changes):
        spark.createDataFrame(changes, schema).write.mode("append").parquet(feed)
        engine.start_stream("t.e", spark.readStream.schema(schema).parquet(feed), check, available_now=True).awaitTermination()

    more(one)
    assert ids(index.search([9.9, 9.9, 9.9], 1)) == [4] and index.manifest["last_seq"] == 7
    before = index.manifest
    index.apply_changes(spark.createDataFrame(one, schema))  # a replay
    assert index.manifest == before
    more([("D", 4, None, 8), ("U", 2, [9.0, 9.0, 9.0], 9)])
    assert ids(index.search([9.9, 9.9, 9.9], 3)) == [2, 3, 1]
    engine.cdc_enabled = False
    with pytest.raises(CdcDisabled):
        engine.start_stream("t.e", None, check)


def test_refresh_window(spark, engine):
    index = engine.add_index("t.r", "type=KNN,dim=2,track=ts")
    at = lambda h: datetime(2024, 1, 1, h, tzinfo=timezone.utc).replace(tzinfo=None)
    df = spark.createDataFrame([(1, [0.0, 0.0], at(1)), (2, [1.0, 1.0], at(2)), (3, [2.0, 2.0], at(3)), (4, [3.0, 3.0], at(5))], "id long, vec array<float>, ts timestamp")
    index.build(df, "id", "vec", at(2), "ts")
    assert sorted(ids(index.vectors())) == [1, 2]
    index.refresh(df, "id", "vec", "ts", at(3))
    assert sorted(ids(index.vectors())) == [1, 2, 3]


LATERAL = "SELECT q.qid, n.id, n.d FROM near_q q, LATERAL (SELECT v.id, vec_distance(v.vec, q.ask) AS d FROM near_v v ORDER BY d, v.id LIMIT 4) n"


@pytest.mark.parametrize("block", [2, 1000])
def test_lateral_search_is_a_batch_search(spark, engine, rows, monkeypatch, block):
    """Odd rows too: nulls, repeated ids and rows, ragged vectors, one query twice."""
    monkeypatch.setattr("vecspark.engine.knn_lateral", partial(knn_lateral, block=block, chunk=64))
    odd = spark.createDataFrame([(7, [1.0] * 64), (7, [1.0] * 64), (8, [1.0, 2.0]), (9, [])], "id long, vec array<float>")
    lost = spark.createDataFrame([(500, None), (501, None)], "id long, vec array<float>")
    ask = rows.unionByName(odd).where("id < 10").selectExpr("id AS qid", "vec AS ask").cache()
    for base, queries in ((rows.unionByName(odd), ask), (rows.unionByName(odd).unionByName(lost), ask.unionByName(lost.selectExpr("id AS qid", "vec AS ask")))):
        base.cache().createOrReplaceTempView("near_v")
        queries.createOrReplaceTempView("near_q")
        for text in (LATERAL, LATERAL.replace("q.ask)", "q.ask, 'IP')"), LATERAL.replace("q, LATERAL", "AS q JOIN LATERAL").replace("vec_distance", "vector_distance")):
            got = engine.sql(text)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert "near_v" not in plan and "Window" not in plan  # no pair of a query and a row is joined in SQL
            key = lambda r: (r.qid, r.id, None if r.d is None else round(r.d, 9))
            assert sorted(map(repr, map(key, got.collect()))) == sorted(map(repr, map(key, spark.sql(text.replace("vector_distance", "vec_distance")).collect())))


def test_lateral_searches_that_stay():
    found = lambda said: "near"
    assert R.rewrite_lateral(LATERAL, found) == "SELECT q.qid, n.id, n.d FROM near_q q, LATERAL (SELECT id AS id, distance AS d FROM near WHERE near.searchvec <=> q.ask) n"
    for same in (LATERAL.replace("ORDER BY d, v.id", "ORDER BY d"), LATERAL.replace("ORDER BY d,", "ORDER BY d DESC,"), LATERAL.replace("near_v v", "near_v v WHERE v.id > 1"), LATERAL.replace("near_q q", "near_q p"), "WITH near_q AS (SELECT 1) " + LATERAL, f"SELECT '{LATERAL}'"):
        assert R.rewrite_lateral(same, found) == same
    assert R.rewrite_lateral(LATERAL, lambda said: None) == LATERAL
