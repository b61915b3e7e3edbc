"""Helpers that depend on the running session: Python path, shared folder, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
CHECKPOINT_CONF = "spark.checkpoint.dir"


#: Bytes of the batches that Python workers get, set where the session has Spark's own value: with long texts
#: the usual 64 MB, held by the JVM and the worker several times over, is most of a small executor.
BATCH_CONF, BATCH_BYTES, SPARK_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8388608b", "67108864b"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it runs from a source checkout, and bound their batches."""
    if spark.conf.get(BATCH_CONF, None) == SPARK_BATCH_BYTES:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    env = spark.sparkContext.environment
    env.setdefault("MALLOC_ARENA_MAX", "2")  # each thread's own heap keeps what it has freed
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent and the session runs in one local process, a temporary folder is
    made and remembered. On a cluster an absent setting is an error, since a folder of the driver's
    machine would not be visible to the executors.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="vecspark-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table that was written.

    Later reads neither recompute the lineage nor depend on an executor's disk, and the planner
    knows the table's size. The table goes with :func:`release`, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._vecspark_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_vecspark_path", None)
        if path:
            delete_path(df.sparkSession, path)


def positional(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed to c0, c1, ...; so no name of a caller's column can clash or need quoting."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def position(df: DataFrame, name: str) -> str:
    """The name in :func:`positional` of the column ``name``; an exact match goes before one in another case."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name!r}")
    return f"c{found[0]}"


def path_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(target).getLength()) if fs.exists(target) else 0


def broadcast_limit(spark: SparkSession) -> int:
    """The session's own limit for broadcast sides, in bytes; negative when broadcasting is off."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def small_or_hashed(df: DataFrame) -> DataFrame:
    """Hint for the smaller side of a join: broadcast within the session's limit, else shuffled hash.

    ``df`` must come from :func:`cut`, so that its size is measured and not guessed. Stored columns
    are compressed, so a factor of four is allowed for.
    """
    size = path_bytes(df.sparkSession, df._vecspark_path)
    return F.broadcast(df) if 4 * size <= broadcast_limit(df.sparkSession) else df.hint("shuffle_hash")
