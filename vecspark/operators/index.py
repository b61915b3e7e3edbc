"""Vector indexes as versioned tables: flat (KNN), inverted lists (IVF), sharded graphs (HNSW, HNSW_BV).

A version is immutable: its data is written to new folders, then its manifest is renamed into place.
Readers use the version they loaded; a writer that loses a race fails and leaves no trace.

A version has a base, with lists or graphs, and a delta: the rows that changed since, a removed one
without its vector. An update writes a new delta, so it costs what has changed and not the table; searches
pass over base rows that the delta replaces and compare its rows exactly. Once the delta exceeds
``DELTA_SHARE`` of the base, the base is built anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.distance import quantize
from vecspark.operators import knn as K
from vecspark.operators.hnsw import Graph
from vecspark.operators.knn import batch_schema, knn, knn_batch, match, ranked
from vecspark.plans.session import broadcast_limit, delete_path, path_bytes, prepare
from vecspark.sources.options import ColumnOptions
from vecspark.sources.versions import Versions

#: Vectors that a graph shard should hold, and bytes of vectors that it may.
SHARD_ROWS = 100_000
SHARD_BYTES = 64 << 20
#: Bytes of vectors that a task of a search of lists holds, besides the bound on their number.
CHUNK_BYTES = 16 << 20
#: Shards, by their centroids, that a query of an HNSW index visits.
PROBED = 8
#: Rows for each centroid that the centroids of graph shards are fitted on; every row is indexed.
FIT_ROWS = 256
#: Bytes that an index's centroids may have: they travel to every task.
CENTRE_BYTES = 256 << 20
#: Share of the base's rows that a delta may have.
DELTA_SHARE = 0.2
VECTORS = "id long, vec array<float>"
#: Rows as IVF indexes store them: ``home`` is the list of the nearest centroid, ``centroid`` the list a copy lies in.
IVF_ROWS = "id long, vec array<float>, home int, centroid int"
CENTRES = "centroid int, centre array<double>, first int, parts int"


class IndexError_(RuntimeError):
    """The index is missing, closed or too small."""


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: type = np.float32) -> np.ndarray:
    """Arrays as rows of ``dim`` values; longer ones are cut, shorter ones filled with zeros."""
    out = np.zeros((len(column), dim), kind)
    for rows, v in K._by_length(column, kind):
        n = min(dim, v.shape[1])
        out[rows, :n] = v[:, :n]
    return out


class VectorIndex:
    """An index of one vector column. ``name`` is ``database.table.column``."""

    def __init__(self, spark: SparkSession, index_dir: str, name: str, options: ColumnOptions | str, shard_rows: int = SHARD_ROWS):
        self.spark, self.name = prepare(spark), name
        self.options = ColumnOptions.of(options) if isinstance(options, str) else options
        self.versions = Versions(spark, f"{index_dir.rstrip('/')}/{name}")
        self.shard_rows = max(1, min(shard_rows, SHARD_BYTES // (4 * self.options.dim)))
        self.chunk_rows = max(1, min(K.VECTOR_CHUNK, CHUNK_BYTES // (4 * self.options.dim)))
        self.manifest: dict | None = None
        self.searches = 0

    # -- life cycle

    def _rows(self, df: DataFrame, id_col: str, vec_col: str, order_col: str | None = None) -> DataFrame:
        """(id, vec), one row for each id: the last by ``order_col``, and of equally late ones, or without an order,
        the one whose vector is greatest value by value. Null ids and vectors are left out."""
        order = df[order_col] if order_col else F.lit(0)
        rows = df.select(df[id_col].cast("long").alias("id"), F.struct(order.alias("o"), df[vec_col].cast("array<float>").alias("vec")).alias("s")).where("id is not null and s.vec is not null")
        return rows.groupBy("id").agg(F.max("s").alias("s")).select("id", "s.vec")

    def _checked(self, rows: int) -> int:
        if self.options.type.startswith("HNSW") and self.options.size and rows > self.options.size:
            raise IndexError_(f"{rows} rows exceed the index's size of {self.options.size}")
        return rows

    def _write(self, vectors: DataFrame, **state) -> dict:
        """Write a version whose base has all vectors, and commit it."""
        o, parent = self.options, self._parent()
        raw = self.versions.fresh()
        vectors.write.parquet(raw)
        saved = self.spark.read.schema(VECTORS).parquet(raw)
        rows = self._checked(saved.count())
        folders = {"base": raw}
        if o.type == "IVF":
            folders = self._lists(saved, rows)
            delete_path(self.spark, raw)
        elif o.type.startswith("HNSW"):
            folders = self._shards(saved, rows)
            delete_path(self.spark, raw)
        return self._commit(parent, folders, rows, rows, state)

    def _parent(self) -> int:
        return (self.manifest or self.versions.latest() or {"version": 0})["version"]

    def _commit(self, parent: int, parts: dict[str, str], base_rows: int, rows: int, state: dict) -> dict:
        kept = {k: state.get(k, (self.manifest or {}).get(k)) for k in ("last_seq", "last_ts")}
        self.manifest = self.versions.commit({"parent": parent, "parts": parts, "folders": sorted(parts.values()), "base_rows": base_rows, "rows": rows, "options": self.options.text()} | kept)
        self.versions.expire()
        return self.manifest

    def _centres(self, vectors: DataFrame, k: int) -> np.ndarray:
        """Centroids by k-means; none for no rows."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if 8 * k * self.options.dim > CENTRE_BYTES:
            raise IndexError_(f"{k} centroids of {self.options.dim} values exceed {CENTRE_BYTES} bytes")
        if not k:
            return np.zeros((0, self.options.dim))
        return np.array(KMeans(k=k, seed=7, maxIter=10, featuresCol="f").fit(vectors.select(array_to_vector(F.col("vec")).alias("f"))).clusterCenters())

    def _near_centres(self, df: DataFrame, vec_col: str, centres: np.ndarray, n: int, name: str) -> DataFrame:
        """``df`` with an array of the numbers of each vector's ``n`` nearest centroids, near first."""
        shared = self.spark.sparkContext.broadcast(centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for whole in batches:
                for i in range(0, whole.num_rows, 2048):
                    b = whole.slice(i, 2048)
                    v = _matrix(b.column(vec_col), c.shape[1], np.float64)
                    near = ((c * c).sum(axis=1)[None, :] - 2 * v @ c.T).argsort(axis=1, kind="stable")[:, :n].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
                    yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, name])

        return df.mapInArrow(place, df.select("*", F.array(F.lit(0)).alias(name)).schema)

    def _save_centres(self, centres: np.ndarray, first: list[int], parts: list[int]) -> str:
        folder = self.versions.fresh()
        self.spark.createDataFrame([(i, c.tolist(), f, p) for i, (c, f, p) in enumerate(zip(centres, first, parts, strict=True))], CENTRES).coalesce(1).write.parquet(folder)
        return folder

    def _lists(self, saved: DataFrame, rows: int) -> dict[str, str]:
        """Vectors in folders by their two nearest centroids; centroids by k-means on all rows.

        Neighbours across the border of two lists are the ones that a search of few lists loses; a copy
        in the second list lets it find them. A list is searched in chunks, whose number is kept.
        """
        base = self.versions.fresh()
        centres = self._centres(saved, min(self.options.nlist, rows))
        if rows:
            placed = self._near_centres(saved, "vec", centres, 2, "near").select("id", "vec", F.col("near")[0].alias("home"), F.explode("near").alias("centroid"))
        else:
            placed = self.spark.createDataFrame([], IVF_ROWS)
        chunk = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows // self.chunk_rows))))  # parts a hot list, and no more files than tasks
        placed.repartition(F.col("centroid"), chunk).write.partitionBy("centroid").parquet(base)
        sizes = {r.centroid: r["count"] for r in self.spark.read.schema(IVF_ROWS).parquet(base).groupBy("centroid").count().collect()} if rows else {}
        parts = [max(1, -(-sizes.get(i, 0) // self.chunk_rows)) for i in range(len(centres))]
        return {"base": base, "centres": self._save_centres(centres, [0] * len(parts), parts)}

    def _shards(self, saved: DataFrame, rows: int) -> dict[str, str]:
        """Vectors with their shards, and a graph for each shard.

        Up to ``shard_rows`` vectors are one graph. More are put in shards by centroids, which are fitted
        on ``FIT_ROWS`` rows for each; a centroid with too many rows has several shards.
        """
        k = -(-rows // self.shard_rows)
        first, parts, centres = [0] * k, [1] * k, np.zeros((k, self.options.dim))
        sharded = saved.withColumn("shard", F.lit(0))
        if k > 1:
            part = min(1.0, 1.2 * FIT_ROWS * k / rows)
            centres = self._centres(saved.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(part * 1_000_000)), k)
            k = len(centres)
            placed = self._near_centres(saved, "vec", centres, 1, "near").withColumn("c", F.col("near")[0])
            sizes = {r.c: r["count"] for r in placed.groupBy("c").count().collect()}
            parts = [max(1, -(-sizes.get(i, 0) // (2 * self.shard_rows))) for i in range(k)]
            first = (np.cumsum(parts) - parts).tolist()
            table = self.spark.createDataFrame(list(zip(range(k), first, parts, strict=True)), "c int, first int, parts int")
            sharded = placed.join(F.broadcast(table), "c").select("id", "vec", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("shard"))
        base, graphs = self.versions.fresh(), self.versions.fresh()
        sharded.write.parquet(base)
        self._graphs(self.spark.read.schema(VECTORS + ", shard int").parquet(base)).write.parquet(graphs)
        return {"base": base, "graphs": graphs, "centres": self._save_centres(centres, first, parts)}

    def _words(self, vec: Column) -> Column:
        return quantize(vec) if self.metric == "HAMMING" else vec

    def _graphs(self, vectors: DataFrame) -> DataFrame:
        o, metric = self.options, self.metric
        width, kind = (o.dim // 64, np.int64) if metric == "HAMMING" else (o.dim, np.float32)

        def build(key, t):
            t = t.sort_by("id")
            g = Graph(o.dim, metric, o.m, o.ef).build(t["id"].to_numpy(), _matrix(t["vec"], width, kind))
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([len(g.ids)], pa.int64()), pa.array([g.dump()], pa.binary())], names=["shard", "n", "graph"])

        return vectors.select("id", self._words(F.col("vec")).alias("vec"), "shard").groupBy("shard").applyInArrow(build, "shard int, n long, graph binary")

    def build(self, df: DataFrame, id_col: str = "id", vec_col: str = "vec", high_water: datetime | None = None, track_col: str | None = None, order_col: str | None = None) -> dict:
        """Index all rows of ``df`` anew. With ``track_col`` only rows up to ``high_water`` belong to it. Of rows with one
        id the last by ``order_col`` or else ``track_col`` counts, see :meth:`_rows`."""
        if track_col and high_water is not None:
            df = df.where(df[track_col] <= F.lit(high_water))
        return self._write(self._rows(df, id_col, vec_col, order_col or track_col), last_ts=high_water.isoformat() if high_water else None)

    def refresh(self, df: DataFrame, id_col: str, vec_col: str, track_col: str, now: datetime) -> dict:
        """Add or replace rows with ``track_col`` above the last high-water mark and up to ``now``."""
        self._need()
        since = self.manifest.get("last_ts")
        fresh = df.where(df[track_col] <= F.lit(now))
        if since:
            fresh = fresh.where(F.col(track_col) > F.lit(datetime.fromisoformat(since)))
        return self._change(self._rows(fresh, id_col, vec_col, track_col), last_ts=now.isoformat())

    def load(self) -> VectorIndex:
        """Open the last committed version; an index without one opens empty."""
        self.manifest = self.versions.latest()
        if self.manifest is None:
            self._write(self.spark.createDataFrame([], VECTORS))
        return self

    def save(self) -> dict:
        """Every change is committed when made; this returns the open version."""
        self._need()
        return self.manifest

    def drop(self) -> None:
        self.versions.drop()
        self.manifest = None

    def close(self) -> None:
        self.manifest = None

    def _need(self) -> None:
        if self.manifest is None:
            raise IndexError_(f"the index {self.name} is not open")

    # -- rows

    def _base(self) -> DataFrame:
        """All (id, vec) of the base."""
        path = self.manifest["parts"]["base"]
        if self.options.type == "IVF":
            return self.spark.read.schema(IVF_ROWS).parquet(path).where("home = centroid").select("id", "vec")
        return self.spark.read.schema(VECTORS).parquet(path)

    def _delta(self) -> DataFrame | None:
        """(id, vec) of the rows changed since the base; the vector of a removed one is null."""
        path = self.manifest["parts"].get("delta")
        return self.spark.read.schema(VECTORS).parquet(path) if path else None

    def _sized(self, df: DataFrame, path: str) -> DataFrame:
        """A hint by the measured size of the folder that ``df`` reads."""
        return F.broadcast(df) if 4 * path_bytes(self.spark, path) <= broadcast_limit(self.spark) else df.hint("shuffle_hash")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Base rows that the delta doesn't replace."""
        delta = self._delta()
        return rows if delta is None else rows.join(self._sized(delta.select("id"), self.manifest["parts"]["delta"]), "id", "left_anti")

    def vectors(self) -> DataFrame:
        """All (id, vec) of the open version."""
        self._need()
        delta = self._delta()
        return self._base() if delta is None else self._live(self._base()).unionByName(delta.where("vec is not null"))

    def vector(self, id_: int) -> list[float] | None:
        """The vector of an id; None if there is none."""
        row = self.vectors().where(F.col("id") == id_).select("vec").first()
        return None if row is None else list(row.vec)

    def _change(self, changed: DataFrame, **state) -> dict:
        """Replace the rows of distinct ids, or remove those whose vector is null."""
        self._need()
        parent, parts, before = self.manifest["version"], dict(self.manifest["parts"]), self._delta()
        fresh = self.versions.fresh()
        changed.select("id", "vec").write.parquet(fresh)
        new, folder = self.spark.read.schema(VECTORS).parquet(fresh), fresh
        ids = self._sized(new.select("id"), fresh)
        there = self.vectors().join(ids, "id", "left_semi").count()
        if before is not None:
            folder = self.versions.fresh()
            before.join(ids, "id", "left_anti").unionByName(new).write.parquet(folder)
        rows = self._checked(self.manifest["rows"] - there + new.where("vec is not null").count())
        parts["delta"] = folder
        size = self.spark.read.schema(VECTORS).parquet(folder).count()
        if size <= DELTA_SHARE * self.manifest["base_rows"]:
            out, done = self._commit(parent, parts, self.manifest["base_rows"], rows, state), {fresh} - {folder}
        else:
            self.manifest = self.manifest | {"parts": parts}
            out, done = self._write(self.vectors(), **state), {fresh, folder}
        for path in done:
            delete_path(self.spark, path)
        return out

    def upsert(self, rows: DataFrame, order_col: str | None = None, **state) -> dict:
        """Add (id, vec) rows; ids that exist are replaced. Of rows with one id the last by ``order_col`` counts, see :meth:`_rows`."""
        return self._change(self._rows(rows, "id", "vec", order_col), **state)

    def delete(self, ids: DataFrame, **state) -> dict:
        """Remove the ids of a DataFrame with a column ``id``."""
        gone = ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
        return self._change(gone.withColumn("vec", F.lit(None).cast("array<float>")), **state)

    def apply_changes(self, changes: DataFrame) -> dict:
        """Apply (op, id, vec, seq): of each id the change of highest ``seq``, and none up to the last applied.

        ``op`` is I or U to add or replace, D to remove. Of changes of an id with one ``seq`` a removal
        counts last. Replaying a batch changes nothing.
        """
        self._need()
        last = self.manifest.get("last_seq")
        new = changes.where("id is not null and seq is not null")
        if last is not None:
            new = new.where(F.col("seq") > last)
        said = F.struct("seq", (F.upper("op") == "D").alias("gone"), F.col("vec").cast("array<float>").alias("vec"))
        new = new.groupBy(F.col("id").cast("long").alias("id")).agg(F.max(said).alias("s"))
        from vecspark.plans.session import cut, release

        new = cut(new.select("id", "s.seq", F.when(~F.col("s.gone"), F.col("s.vec")).alias("vec")), "changes")
        high = new.agg(F.max("seq")).first()[0]
        out = self.manifest if high is None else self._change(new, last_seq=int(high))
        release(new)
        return out

    # -- search

    @property
    def metric(self) -> str:
        return "HAMMING" if self.options.type == "HNSW_BV" else self.options.dist

    def _centre_table(self) -> list:
        """The rows of the centroids, whose bytes are bounded."""
        return sorted(self.spark.read.schema(CENTRES).parquet(self.manifest["parts"]["centres"]).collect(), key=lambda r: r.centroid)

    def search(self, query: Sequence[float], k: int = 10, effort: int | None = None) -> DataFrame:
        """(id, distance) of about the ``k`` nearest, near first; ``effort`` holds for this search only.

        KNN ignores it. HNSW takes it as the beam's width, IVF as the number of lists to read.
        """
        self._need()
        self.searches += 1
        if self.options.type == "KNN":
            return knn(self.vectors(), query, k, self.options.dist).select("id", "distance")
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "qid long, searchvec array<float>")
        return self.search_batch(one, k, effort).orderBy("distance", "id").limit(k).select("id", "distance")

    def search_batch(self, queries: DataFrame, k: int = 10, effort: int | None = None, query_id: str = "qid", query_vec: str = "searchvec") -> DataFrame:
        """(``query_id``, ``rank``, id, distance) for each query row."""
        self._need()
        o, metric = self.options, self.metric
        if o.type == "KNN":
            return knn_batch(self.vectors(), queries, k, o.dist, query_id=query_id, query_vec=query_vec)
        asked = queries.where(queries[query_vec].isNotNull()).select(queries[query_id].alias("q"), queries[query_vec].alias("searchvec"))
        schema = batch_schema(queries, query_id, self.spark.range(0).schema["id"].dataType)
        centres = self._centre_table()
        parts = []
        if centres:
            n = effort or max(1, min(o.nlist, o.ef_search)) if o.type == "IVF" else PROBED
            n = min(n, len(centres))
            if len(centres) > 1:
                near = self._near_centres(asked, "searchvec", np.array([r.centre for r in centres]), n, "near")
            else:
                near = asked.withColumn("near", F.array(F.lit(0)))
            probes = near.select("q", "searchvec", F.explode("near").alias("centroid"))
            counts = {r.centroid: r["count"] for r in probes.groupBy("centroid").count().collect()}
            blocks = self.spark.createDataFrame([(c, -(-m // K.QUERY_BLOCK), centres[c].first, centres[c].parts) for c, m in counts.items()], "centroid int, blocks int, first int, parts int")
            probes = probes.join(F.broadcast(blocks), "centroid").withColumn("block", F.pmod(F.xxhash64("q", "searchvec"), F.col("blocks")).cast("int"))
            probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            parts.append((self._search_lists if o.type == "IVF" else self._search_graphs)(probes, blocks, list(counts), k, effort or o.ef_search, schema))
        if (delta := self._delta()) is not None:
            words = lambda df, c: df.withColumn(c, self._words(F.col(c)))
            found = knn_batch(words(delta.where("vec is not null"), "vec"), words(asked, "searchvec"), k, metric, query_id="q")
            parts.append(found.select("q", "id", "distance"))
        found = parts[0] if parts else self.spark.createDataFrame([], schema)
        for p in parts[1:]:
            found = found.unionByName(p)
        return ranked(found, k, query_id, "id")

    def _search_lists(self, probes: DataFrame, blocks: DataFrame, read: list[int], k: int, _: int, schema) -> DataFrame:
        """The nearest of each query in each chunk of its lists."""
        metric = self.metric
        rows = self._live(self.spark.read.schema(IVF_ROWS).parquet(self.manifest["parts"]["base"]).where(F.col("centroid").isin(read)).select("id", "vec", "centroid"))
        rows = rows.join(F.broadcast(blocks), "centroid").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        key = ("centroid", "part", "block")
        both = probes.select(*key, "q", "searchvec").groupBy(*key).cogroup(rows.select(*key, "id", "vec").groupBy(*key))
        return both.applyInArrow(lambda q, v: match(q, v, metric, k), schema)

    def _search_graphs(self, probes: DataFrame, blocks: DataFrame, read: list[int], k: int, beam: int, schema) -> DataFrame:
        """The nearest of each query in the graph of each shard that it visits."""
        o, metric, p = self.options, self.metric, self.manifest["parts"]
        width, kind = (o.dim // 64, np.int64) if metric == "HAMMING" else (o.dim, np.float32)
        shards = blocks.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("shard"), "blocks")
        graphs = self.spark.read.schema("shard int, n long, graph binary").parquet(p["graphs"]).join(F.broadcast(shards), "shard")
        if "delta" in p:
            ids = self._sized(self._delta().select("id"), p["delta"])
            gone = self.spark.read.schema("id long, shard int").parquet(p["base"]).join(ids, "id", "left_semi").groupBy("shard").agg(F.collect_list("id").alias("gone"))
            graphs = graphs.join(gone, "shard", "left")
        else:
            graphs = graphs.withColumn("gone", F.lit(None).cast("array<long>"))
        graphs = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "graph", "gone")
        asked = probes.select((F.col("first") + F.col("part")).alias("shard"), "block", "q", self._words(F.col("searchvec")).alias("searchvec"))

        def visit(q: pa.Table, graph: pa.Table) -> pa.Table:
            none = pa.table([q["q"].slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["q", "id", "distance"])
            if not len(graph) or not len(q):
                return none
            g = Graph.load(graph["graph"][0].as_py(), metric)
            gone = graph["gone"][0].as_py()
            row, found, far = g.search(_matrix(q["searchvec"], width, kind), k, beam, None if gone is None else np.array(gone))
            return pa.table([q["q"].take(pa.array(row)), pa.array(found), pa.array(far)], names=["q", "id", "distance"])

        return asked.groupBy("shard", "block").cogroup(graphs.groupBy("shard", "block")).applyInArrow(visit, schema)

    # -- about the index

    def integrity(self) -> DataFrame:
        """Rows (``shard``, ``fault``): what is wrong with the graphs, and ids that the rows and the graphs don't share."""
        self._need()
        p, metric = self.manifest["parts"], self.metric
        if "graphs" not in p:
            return self.spark.createDataFrame([], "shard int, fault string")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, raw in zip(b.column("shard").to_pylist(), b.column("graph"), strict=True):
                    faults = Graph.load(raw.as_py(), metric).faults()
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(faults), pa.int32()), pa.array(faults, pa.string())], names=["shard", "fault"])

        def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, raw in zip(b.column("shard").to_pylist(), b.column("graph"), strict=True):
                    ids = Graph.load(raw.as_py(), metric).ids
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), shard, np.int32))], names=["id", "shard"])

        graphs = self.spark.read.schema("shard int, n long, graph binary").parquet(p["graphs"])
        rows = self.spark.read.schema("id long, shard int").parquet(p["base"])
        apart = rows.withColumn("r", F.lit(1)).join(graphs.mapInArrow(labels, "id long, shard int").withColumn("g", F.lit(1)), ["id", "shard"], "full").where("r is null or g is null")
        return graphs.mapInArrow(check, "shard int, fault string").unionByName(apart.select("shard", F.concat(F.lit("id "), "id", F.lit(" is not in both rows and graph")).alias("fault")))

    def status(self) -> DataFrame:
        """One row about the index."""
        self._need()
        o, m = self.options, self.manifest
        row = (self.name, o.type, o.dim, self.metric, o.size, o.m, o.ef, int(m["rows"]), self.searches, int(m["version"]), m.get("last_seq"), m.get("last_ts"))
        return self.spark.createDataFrame([row], "name string, type string, dim int, metric string, capacity long, m int, ef int, n_rows long, searches long, version long, last_seq long, last_ts string")
