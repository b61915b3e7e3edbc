"""Versioned folders: data of a version is written first, its manifest is renamed into place last."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

from vecspark.plans.session import delete_path


class VersionConflict(Exception):
    """Another writer committed this version first."""


class Versions:
    """Numbered versions under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def all(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def latest(self) -> dict | None:
        """The last manifest with its ``version``; None before the first commit."""
        found = self.all()
        return self.read(found[-1]) if found else None

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": version}

    def fresh(self) -> str:
        """A folder for data that no version has yet."""
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def commit(self, manifest: dict) -> dict:
        """Add the next version after ``manifest['parent']``, 0 for none."""
        jvm = self.spark.sparkContext._jvm
        version = manifest.get("parent", 0) + 1
        aside, place = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/v{version}.json")
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        out = self._fs.create(aside, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf).rename(aside, place, none)
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(place):
                raise VersionConflict(f"version {version} exists") from e
            raise
        return manifest | {"version": version}

    def expire(self, keep: int = 2) -> None:
        """Forget all but the last ``keep`` versions and the folders that only they name."""
        found = self.all()
        live = {f for v in found[-keep:] for f in self.read(v)["folders"]}
        for v in found[:-keep]:
            for f in set(self.read(v)["folders"]) - live:
                delete_path(self.spark, f)
            self._fs.delete(self._path(f"{self.root}/manifests/v{v}.json"), False)

    def sweep(self, grace: float = 86_400) -> list[str]:
        """Delete folders of data that no version names and that are older than ``grace`` seconds: what dead writers left."""
        folder = self._path(f"{self.root}/data")
        live = {f.rsplit("/", 1)[1] for v in self.all() for f in self.read(v)["folders"]}
        gone = []
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() not in live and s.getModificationTime() < (time.time() - grace) * 1000:
                gone.append(s.getPath().toString())
                self._fs.delete(s.getPath(), True)
        return gone

    def drop(self) -> None:
        delete_path(self.spark, self.root)
