"""Operator 5: sharded tables with size-tiered compaction and versioned manifests.

An arrival is written as small immutable shards. Compaction takes shards below the target size in
tiers, a tier holding sizes within a factor ``FANOUT``, and merges each tier that has ``FANOUT`` shards
into files of up to the target size. The file scan packs whole files into tasks of that size, so each
task writes one merged shard and nothing is shuffled.

Shards are listed in immutable Parquet tables, one for each arrival or merge. A version is a manifest, a
small JSON file that names its lists; it is written aside and renamed to its number, which fails if
another writer took it. A commit writes only the lists that it changes, and the driver holds the names
of lists and of the small shards of one round of compaction, ``PLANNED`` at most. What no manifest
names is not part of the table, so a job that dies leaves the table as it was; :meth:`ShardStore.sweep`
deletes what it left.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.plans.session import delete_path, prepare

TARGET_BYTES = 64 << 20
FANOUT = 4
#: Sizes up to this are one tier.
LEAST_BYTES = 1 << 20
#: Small shards that a round of compaction looks at, the smallest first; the next round sees the others.
PLANNED = 100_000
#: Shards that a file of a list names.
LISTED = 100_000
SHARD = "path string, bytes long"
#: Seconds after which a folder that no version names was left by a dead job.
GRACE = 86_400


class Conflict(Exception):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str | None
    #: Folders of the Parquet tables that list the shards.
    lists: tuple[str, ...]


class ShardStore:
    """A table of immutable shards under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, keep_versions: int = 2):
        if fanout < 2 or keep_versions < 1 or target_bytes < 1:
            raise ValueError("fanout is 2 at least, keep_versions and target_bytes 1")
        self.spark = prepare(spark)
        self.root, self.target, self.fanout, self.keep_versions = root.rstrip("/"), target_bytes, fanout, keep_versions
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, by default the latest; version 0 is the empty table."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        if version == 0:
            return Manifest(0, None, ())
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        said = json.loads(text)
        return Manifest(version, said["schema"], tuple(said["lists"]))

    def _commit(self, m: Manifest) -> Manifest:
        jvm = self.spark.sparkContext._jvm
        aside, place = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/v{m.version}.json")
        out = self._fs.create(aside, False)
        out.write(json.dumps({"schema": m.schema, "lists": m.lists}).encode())
        out.close()
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf).rename(aside, place, rename)
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(place):
                raise Conflict(f"version {m.version} exists") from e
            raise
        return m

    def _list(self, shards: DataFrame) -> str:
        """Write a list of shards."""
        path = f"{self.root}/lists/{uuid.uuid4().hex}"
        shards.select("path", "bytes").coalesce(1).write.option("maxRecordsPerFile", LISTED).parquet(path)
        return path

    def _written(self, folders: list[str]) -> DataFrame:
        """The shards in folders of data."""
        each = (s for f in folders for s in self._fs.listStatus(self._path(f)))
        found = sorted((s.getPath().toString(), int(s.getLen())) for s in each if s.getPath().getName().startswith("part-"))
        return self.spark.createDataFrame(found, SHARD)

    def shards(self, *lists: str) -> DataFrame:
        """Rows (``path``, ``bytes``, ``list``) of the shards in lists."""
        if not lists:
            return self.spark.createDataFrame([], SHARD + ", list string")
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/lists/([0-9a-f]+)/", 1)
        return self.spark.read.schema(SHARD).parquet(*lists).select("path", "bytes", F.concat(F.lit(f"{self.root}/lists/"), folder).alias("list"))

    def tiers(self, version: int | None = None) -> DataFrame:
        """Rows (``tier``, ``shards``, ``bytes``) of a version; tier -1 has the shards that are large enough."""
        size = F.greatest(F.col("bytes"), F.lit(1)) / LEAST_BYTES
        tier = F.when(2 * F.col("bytes") >= self.target, -1).when(F.col("bytes") <= LEAST_BYTES, 0).otherwise(1 + F.floor(F.log(float(self.fanout), size)))
        return self.shards(*self.manifest(version).lists).groupBy(tier.cast("int").alias("tier")).agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes"))

    def append(self, df: DataFrame) -> Manifest:
        """Write ``df`` as new shards, one for each of its partitions, and commit them.

        The first arrival gives the table its columns; a later one must have the same. If another
        writer commits meanwhile, the commit is repeated on top of its version. An empty arrival
        commits shards without rows. Null values and repeated rows are kept as they are.
        """
        schema = df.schema.json()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        own = None
        while True:
            now = self.manifest()
            if now.schema and T.StructType.fromJson(json.loads(now.schema)).simpleString() != df.schema.simpleString():
                raise ValueError("the arrival's columns differ from the table's")
            if own is None:
                df.write.parquet(folder)
                own = self._list(self._written([folder]))
            try:
                return self._commit(Manifest(now.version + 1, now.schema or schema, (*now.lists, own)))
            except Conflict:
                continue

    def tier(self, size: int) -> int:
        return 0 if size <= LEAST_BYTES else 1 + int(math.log(size / LEAST_BYTES, self.fanout))

    def plan(self, m: Manifest) -> list[tuple[Shard, ...]]:
        """Runs of shards to merge: each tier below half the target with ``fanout`` shards or more."""
        tiers: dict[int, list[Shard]] = {}
        for r in self.shards(*m.lists).where(2 * F.col("bytes") < self.target).orderBy("bytes", "path").limit(max(PLANNED, 64 * self.fanout)).collect():
            tiers.setdefault(self.tier(r.bytes), []).append(Shard(r.path, r.bytes))
        return [tuple(run) for _, run in sorted(tiers.items()) if len(run) >= self.fanout]

    def compact(self) -> Manifest:
        """Merge runs until no tier is full, committing after each round; then forget old versions.

        If an append is committed meanwhile, its shards are kept. If another compaction changed a list
        that names a shard of the run, the merge is thrown away and planned anew.
        """
        while runs := self.plan(now := self.manifest()):
            session = self.spark.newSession()
            session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
            session.conf.set("spark.sql.files.openCostInBytes", "0")
            session.conf.set("spark.sql.files.minPartitionNum", "1")
            schema = T.StructType.fromJson(json.loads(now.schema))
            folders = []
            for run in runs:
                folders.append(f"{self.root}/data/{uuid.uuid4().hex}")
                session.read.schema(schema).parquet(*[s.path for s in run]).write.parquet(folders[-1])
            merged = self.spark.createDataFrame([(s.path,) for run in runs for s in run], "path string")
            every = self.shards(*now.lists)
            changed = {r.list for r in every.join(merged, "path", "left_semi").select("list").distinct().collect()}
            left = self.shards(*changed).join(merged, "path", "left_anti").select("path", "bytes")
            new = self._list(left.unionByName(self._written(folders)))
            while True:
                at = self.manifest()
                if not changed <= set(at.lists):
                    for f in [*folders, new]:
                        delete_path(self.spark, f)
                    break
                try:
                    self._commit(Manifest(at.version + 1, at.schema, (*[x for x in at.lists if x not in changed], new)))
                    break
                except Conflict:
                    continue
            self.expire()
        return self.manifest()

    def expire(self) -> None:
        """Delete manifests before the last ``keep_versions`` with the lists and shards that only they name."""
        found = self.versions()
        old, live = found[: -self.keep_versions], found[-self.keep_versions :]
        if not old:
            return
        kept = {x for v in live for x in self.manifest(v).lists}
        gone = {x for v in old for x in self.manifest(v).lists} - kept
        if gone:
            for r in self.shards(*gone).join(self.shards(*kept).select("path"), "path", "left_anti").select("path").distinct().toLocalIterator():
                self._fs.delete(self._path(r.path), False)
        for v in old:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v}.json"), False)
        for x in gone:
            delete_path(self.spark, x)

    def sweep(self, grace: float = GRACE) -> list[str]:
        """Delete folders of data and lists that no version names and that are older than ``grace`` seconds."""
        lists = {x for v in self.versions() for x in self.manifest(v).lists}
        named = {r.f for r in self.shards(*lists).select(F.regexp_extract("path", "/data/([0-9a-f]+)/", 1).alias("f")).distinct().collect()}
        named |= {x.rsplit("/", 1)[1] for x in lists}
        gone = []
        for kind in ("data", "lists"):
            folder = self._path(f"{self.root}/{kind}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if s.getPath().getName() not in named and s.getModificationTime() < (time.time() - grace) * 1000:
                    gone.append(s.getPath().toString())
                    self._fs.delete(s.getPath(), True)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. A table without arrivals can't be read: it has no columns."""
        m = self.manifest(version)
        if m.schema is None:
            raise ValueError("the table has no arrival yet")
        schema = T.StructType.fromJson(json.loads(m.schema))
        paths = [r.path for r in self.shards(*m.lists).select("path").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)
