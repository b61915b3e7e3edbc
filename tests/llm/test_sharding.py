import pytest

from vecspark.llm import sharding as S
from vecspark.plans.session import scratch_path

SCHEMA = "doc_id long, text string, path string"


def frame(spark, a, b, parts=4):
    return spark.createDataFrame([(i if i % 7 else None, None if i % 5 == 0 else f"text {i} " * 50, "p") for i in range(a, b)], SCHEMA).repartition(parts)


def rows(df):
    return sorted(map(str, df.collect()))


def test_compaction_keeps_rows_and_sizes(spark):
    store = S.ShardStore(spark, scratch_path(spark, "shards"), target_bytes=40_000, fanout=3)
    want = []
    for i in range(5):
        df = frame(spark, i * 200, i * 200 + 200).cache()
        want += rows(df)
        store.append(df)
        assert rows(store.read()) == sorted(want)
        m = store.compact()
        assert rows(store.read()) == sorted(want)
        shards = store.shards(*m.lists).collect()
        assert not store.plan(m) and all(s.bytes <= 1.2 * store.target for s in shards)
        tiers = {r.tier: (r.shards, r.bytes) for r in store.tiers().collect()}
        sizes = {}
        for x in shards:
            sizes.setdefault(-1 if 2 * x.bytes >= store.target else store.tier(x.bytes), []).append(x.bytes)
        assert tiers == {t: (len(b), sum(b)) for t, b in sizes.items()} and all(n < store.fanout for t, (n, _) in tiers.items() if t >= 0)
    assert len(store.versions()) <= store.keep_versions + 1
    store.expire()
    listed = {s.path.split("/data/")[1] for v in store.versions() for s in store.shards(*store.manifest(v).lists).collect()}
    found, there = store._fs.listFiles(store._path(f"{store.root}/data"), True), set()
    while found.hasNext():
        p = found.next().getPath().toString()
        if "/part-" in p:
            there.add(p.split("/data/")[1])
    assert there == listed
    assert rows(store.read()) == sorted(want)


def test_snapshots_stay(spark):
    store = S.ShardStore(spark, scratch_path(spark, "shards"), target_bytes=1 << 20, fanout=2, keep_versions=10)
    store.append(frame(spark, 0, 10, 2))
    before = store.manifest()
    store.append(frame(spark, 10, 20, 2))
    store.compact()
    assert store.read(before.version).count() == 10 and store.read().count() == 20
    assert store.shards(*store.manifest().lists).count() == 1


def test_conflicts(spark, monkeypatch):
    store = S.ShardStore(spark, scratch_path(spark, "shards"), fanout=2)
    store.append(frame(spark, 0, 10, 1))
    with pytest.raises(S.Conflict):
        store._commit(store.manifest())
    other = S.ShardStore(spark, store.root, fanout=2)
    commit, raced = store._commit, []

    def late(m):
        if not raced:
            raced.append(1)
            other.append(frame(spark, 10, 20, 1))
        return commit(m)

    monkeypatch.setattr(store, "_commit", late)
    store.append(frame(spark, 20, 30, 1))
    assert store.read().count() == 30
    raced.clear()
    monkeypatch.setattr(store, "_commit", late)
    store.compact()  # an append slips in before the merge is committed
    assert store.read().count() == 40


def test_rounds_see_the_smallest_shards_first(spark, monkeypatch):
    monkeypatch.setattr(S, "PLANNED", 1)
    store = S.ShardStore(spark, scratch_path(spark, "shards"), target_bytes=1 << 20, fanout=2)
    for i in range(3):
        store.append(frame(spark, i * 300, i * 300 + 300, 50))
    store.compact()
    assert store.read().count() == 900 and not store.plan(store.manifest())


def test_sweep(spark):
    store = S.ShardStore(spark, scratch_path(spark, "shards"), fanout=2)
    store.append(frame(spark, 0, 10, 1))
    dead = f"{store.root}/data/{'0' * 32}"
    frame(spark, 0, 10, 1).write.parquet(dead)  # as a job leaves it that died before its commit
    assert store.sweep() == []
    assert [x.rsplit("/", 1)[1] for x in store.sweep(grace=-60)] == ["0" * 32]
    assert store.sweep(grace=-60) == [] and store.read().count() == 10


def test_odd_tables(spark):
    store = S.ShardStore(spark, scratch_path(spark, "shards"), fanout=2)
    with pytest.raises(ValueError, match="no arrival"):
        store.read()
    empty = spark.createDataFrame([], SCHEMA)
    store.append(empty)
    store.append(empty)
    store.compact()
    assert store.read().count() == 0 and store.read().columns == empty.columns
    twice = frame(spark, 0, 8, 1)
    store.append(twice)
    store.append(twice)
    store.compact()
    assert store.read().count() == 16
    with pytest.raises(ValueError, match="differ"):
        store.append(spark.range(3))
    with pytest.raises(ValueError):
        S.ShardStore(spark, store.root, fanout=1)
    long = spark.createDataFrame([(1, "x" * 3_000_000, "p")], SCHEMA)
    store.append(long)
    assert store.compact() and store.read().count() == 17
