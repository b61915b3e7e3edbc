"""The engine: a session with vector functions, annotated SQL, a registry of indexes and their procedures."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.codec import conversion, register_codec
from vecspark.functions.distance import register_distances
from vecspark.operators.index import VectorIndex
from vecspark.operators.knn import ann_set, knn_lateral
from vecspark.plans import rewrite
from vecspark.plans.session import cut, prepare, shared_dir
from vecspark.sources.config import read_config
from vecspark.sources.options import MAX_K, ColumnOptions, search_options
from vecspark.streaming.cdc import CdcDisabled, follow


#: Names of metrics in vec_distance.
LATERAL_METRICS = ("L2", "EUCLIDEAN", "IP", "COSINE", "ANGULAR", "COSINENORM")


class EngineError(ValueError):
    """An unknown column or index, or a call with wrong arguments."""


class Engine:
    """``prefix`` begins the names of the SQL functions; the same session may have several. An odd ``feature_level``
    turns following of changes off, as ``cdc_enabled`` does."""

    def __init__(self, spark: SparkSession, index_dir: str | None = None, prefix: str = "vec_", cdc_enabled: bool = True, config_file: str | None = None, feature_level: int | None = None):
        settings = read_config(config_file) if config_file else {}
        self.spark = prepare(spark)
        self.index_dir = (index_dir or settings.get("index_dir") or f"{shared_dir(spark)}/indexes").rstrip("/")
        self.prefix = prefix
        self.feature_level = int(settings.get("feature_level", 2)) if feature_level is None else feature_level
        if not 1 <= self.feature_level <= 100:
            raise EngineError("feature_level is 1 to 100")
        self.cdc_enabled = cdc_enabled and settings.get("cdc_enabled", "Y").upper() != "N" and self.feature_level % 2 == 0
        self.registry: dict[str, VectorIndex] = {}
        self.streams: dict[str, object] = {}
        register_codec(spark, "vec_")
        register_distances(spark, "vec_")
        if prefix != "vec_":
            register_codec(spark, prefix)
            register_distances(spark, prefix)

    # -- catalog

    def vector_columns(self) -> DataFrame:
        """(db, tbl, col, options) of every annotated column, in order."""
        rows = []
        for db in self.spark.catalog.listDatabases():
            for t in self.spark.catalog.listTables(db.name):
                if t.isTemporary:
                    continue
                for f in self.spark.table(f"{db.name}.{t.name}").schema:
                    note = f.metadata.get("comment", "")
                    if note.startswith(rewrite.COMMENT):
                        rows.append((db.name, t.name, f.name, note[len(rewrite.COMMENT) :]))
        return self.spark.createDataFrame(sorted(rows), "db string, tbl string, col string, options string")

    def column_options(self, name: str) -> ColumnOptions:
        """Options from the comment of the column ``db.table.column`` or ``table.column``."""
        table, _, column = name.rpartition(".")
        if not table or not self.spark.catalog.tableExists(table):
            raise EngineError(f"no such vector column: {name}")
        fields = {f.name: f for f in self.spark.table(table).schema}
        note = fields[column].metadata.get("comment", "") if column in fields else ""
        if not note.startswith(rewrite.COMMENT):
            raise EngineError(f"not a vector column: {name}")
        return ColumnOptions.of(note)

    def add_index(self, name: str, options: str | ColumnOptions) -> VectorIndex:
        """Register an index for vectors that no annotated table holds."""
        self.registry[name] = VectorIndex(self.spark, self.index_dir, name, options)
        return self.registry[name]

    def index(self, name: str) -> VectorIndex:
        if name not in self.registry or self.registry[name].manifest is None:
            raise EngineError(f"the index {name} is not open")
        return self.registry[name]

    # -- procedures

    def index_build(self, name: str, id_col: str) -> DataFrame:
        o = self.column_options(name)
        table, _, column = name.rpartition(".")
        index = self.registry.get(name) or self.add_index(name, o)
        made = index.build(self.spark.table(table), id_col, column, datetime.now(timezone.utc) if o.track else None, o.track)
        return self._said(f"SUCCESS: index created and saved as version {made['version']}, rows: {made['rows']}")

    def index_refresh(self, name: str, id_col: str) -> DataFrame:
        o = self.column_options(name)
        if not o.track:
            raise EngineError(f"{name} has no track column")
        table, _, column = name.rpartition(".")
        made = self.index(name).refresh(self.spark.table(table), id_col, column, o.track, datetime.now(timezone.utc))
        return self._said(f"SUCCESS: index refreshed as version {made['version']}, rows: {made['rows']}")

    def index_load(self, name: str) -> DataFrame:
        index = self.registry.get(name) or self.add_index(name, self.column_options(name))
        return self._said(f"SUCCESS: version {index.load().manifest['version']}")

    def index_save(self, name: str) -> DataFrame:
        return self._said(f"SUCCESS: version {self.index(name).save()['version']}")

    def index_drop(self, name: str) -> DataFrame:
        self.index(name).drop()
        del self.registry[name]
        return self._said("SUCCESS: index dropped")

    def index_status(self, name: str) -> DataFrame:
        return self.index(name).status()

    def _said(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "status string")

    # -- search

    def _vector(self, expression: str) -> list[float] | None:
        row = self.spark.sql(f"SELECT {self._functions(expression)} AS v").first()
        return None if row.v is None else [float(x) for x in row.v]

    def ann(self, name: str, vector: list[float] | None, options: str | int | None = None) -> DataFrame:
        """(id, distance) of the neighbours of a vector; none for a null one."""
        index = self.index(name)
        if vector is None:
            return self.spark.createDataFrame([], "id long, distance double")
        k, effort = search_options(options, index.options.ef_search)
        return index.search(vector, k, effort)

    def ann_batch(self, name: str, queries: DataFrame, options: str | int | None = None) -> DataFrame:
        """(qid, rank, id, distance) for each row of ``queries``, which needs a column ``searchvec``."""
        index = self.index(name)
        k, effort = search_options(options, index.options.ef_search)
        return index.search_batch(queries, k, effort, "qid")

    def _view(self, df: DataFrame) -> str:
        name = f"__near_{uuid.uuid4().hex}"
        names = {"id": "near_id", "distance": "near_distance"}
        df.withColumnsRenamed(names).createOrReplaceTempView(name)
        return name

    def _is_ann(self, column: str, _: str, expression: str, options: str | None) -> str:
        near = self.ann(column, self._vector(expression), options)
        return self._view(self.spark.createDataFrame(near.toArrow()))  # at most MAX_K rows, a local relation: one search serves all uses

    def _search(self, column: str, _: str, queries: str, options: str | None) -> str:
        rows = self.spark.table(queries).select(F.monotonically_increasing_id().alias("qid"), "searchvec")
        return self._view(cut(self.ann_batch(column, rows, options).select("id").distinct(), "near"))

    def _lateral(self, said: dict[str, str]) -> str | None:
        """The neighbours of every query vector, by one batch search; None where the batch search hasn't SQL's results."""
        if not self.spark.catalog.tableExists(said["base"]) or not self.spark.catalog.tableExists(said["queries"]):
            return None
        base, queries, k = self.spark.table(said["base"]), self.spark.table(said["queries"]), int(said["k"])
        for df, name in ((base, said["vec"]), (queries, said["searchvec"])):
            found = [t for c, t in df.dtypes if c.lower() == name.lower()]
            if found != ["array<float>"] or not df.where(F.exists(df[name], lambda x: x.isNull())).isEmpty():  # a null among the values makes a distance null
                return None
        if not 1 <= k <= MAX_K or (said["metric"] or "L2").upper() not in LATERAL_METRICS:
            return None
        near = knn_lateral(base, queries, k, said["metric"] or "L2", said["id"], said["vec"], said["searchvec"])
        name = f"__near_{uuid.uuid4().hex}"
        near.createOrReplaceTempView(name)
        return name

    def _functions(self, sql: str) -> str:
        return rewrite.rewrite_functions(sql, conversion)

    def _ann_set(self, column: str, _: str, expression: str, options: str | None) -> str:
        """The ids as a literal, near first; null for a null vector."""
        vector = self._vector(expression)
        if vector is None:
            return "CAST(NULL AS STRING)"
        return f"'{ann_set(self.ann(column, vector, options)).first().ids}'"

    def ann_sets(self, name: str, queries: DataFrame, options: str | int | None = None) -> DataFrame:
        """(qid, ids) for each row of ``queries`` (qid, searchvec): the neighbours' ids, near first, as JSON text."""
        near = self.ann_batch(name, queries, options)
        ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"])
        return near.groupBy("qid").agg(F.to_json(ids).alias("ids"))

    def sql(self, text: str) -> DataFrame:
        """Run annotated SQL. Statements without annotations go to Spark as they are."""
        call = rewrite.parse_call(text)
        if call:
            action, args = call
            if len(args) != (2 if action in ("build", "refresh") else 1):
                raise EngineError(f"wrong number of arguments for {action}")
            return getattr(self, f"index_{action}")(*args)
        if re.search("VECTOR|VEC_CONSTRUCT|LATERAL", text, re.I):
            if re.match(r"\s*(CREATE|ALTER)\s+TABLE\b", text, re.I):
                text = rewrite.rewrite_columns(text)
            elif re.match(r"\s*(SELECT|EXPLAIN|WITH)\b", text, re.I):
                new = rewrite.rewrite_is_ann(rewrite.rewrite_sets(text, self._ann_set), self._is_ann)
                new = new if new != text else rewrite.rewrite_search(text, self._search)
                text = self._functions(new if re.match(r"\s*EXPLAIN\b", text, re.I) else rewrite.rewrite_lateral(new, self._lateral))
        return self.spark.sql(text)

    # -- changes

    def start_stream(self, name: str, changes: DataFrame, checkpoint: str, **how):
        """Follow a stream of changes; the index must be open."""
        if not self.cdc_enabled:
            raise CdcDisabled("following changes is off")
        self.streams[name] = follow(self.index(name), changes, checkpoint, **how)
        return self.streams[name]

    def start_online(self, changes: Callable[[str], DataFrame], checkpoint: str, **how) -> dict:
        """Follow the changes of every annotated column with ``online=Y``; ``changes`` gives the stream of a column's name.

        Indexes that aren't open are loaded. Columns that are followed already, or without ``idcol``, are left out.
        """
        started = {}
        for r in self.vector_columns().collect():
            name, o = f"{r.db}.{r.tbl}.{r.col}", ColumnOptions.of(r.options)
            if not o.online or not o.idcol or name in self.streams:
                continue
            if name not in self.registry or self.registry[name].manifest is None:
                self.index_load(name)
            started[name] = self.start_stream(name, changes(name), f"{checkpoint.rstrip('/')}/{name}", **how)
        return started
