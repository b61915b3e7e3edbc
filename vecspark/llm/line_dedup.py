"""Operator 6: removal of repeated passages by overlapping windows of three lines.

Every three consecutive lines of a text are hashed (128 bits). A window that occurs more than once in
the corpus keeps its first occurrence, by document id and position; the lines that later occurrences
cover are removed, overlapping windows together. The hashes are written once; only those of repeated
windows are sorted, and a text travels at most once, to meet the positions of its own windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.arrow_text import slices
from vecspark.plans.session import cut, position, positional, prepare, release, small_or_hashed

WINDOW = 3


def window_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``id``, ``h``, ``pos``, ``k1``, ``k2``): one for each window of each distinct id and text.

    Lines are compared without spaces at their ends. Windows of blank lines only are left out.
    """
    one = df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("h"), F.transform(F.split(df[text_col], "\n", -1), lambda x: F.trim(x)).alias("l"))
    starts = F.when(F.size("l") >= WINDOW, F.sequence(F.lit(0), F.size("l") - WINDOW)).otherwise(F.array().cast("array<int>"))
    spread = one.select("id", "h", "l", F.explode(starts).alias("pos"))
    lines = [F.get("l", F.col("pos") + i) for i in range(WINDOW)]
    some = F.concat(*lines) != ""
    return spread.where(some).select("id", "h", "pos", F.xxhash64(*lines).alias("k1"), F.xxhash64(F.lit("second"), *lines).alias("k2"))


def repeated_positions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``id``, ``h``, ``at``), written to the shared folder: positions of the windows of each text that occurred before."""
    windows = cut(window_table(df, id_col, text_col).dropDuplicates(["id", "h", "pos"]), "windows")
    often = cut(windows.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "often")
    again = windows.join(small_or_hashed(often), ["k1", "k2"])
    place = F.struct(F.col("id").isNull().alias("gone"), "id", "h", "pos")
    again = again.select("k1", "k2", place.alias("place"))
    first = again.groupBy("k1", "k2").agg(F.min("place").alias("first"))
    later = again.join(first, ["k1", "k2"]).where(F.col("place") != F.col("first"))
    out = cut(later.groupBy("place.id", "place.h").agg(F.collect_set("place.pos").alias("at")), "positions")
    release(windows, often)
    return out


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = "n_removed") -> DataFrame:
    """The rows of ``df`` with all their columns, ``text_col`` without repeated passages.

    ``removed_col`` is added with the number of removed lines; it replaces a column of that name, and
    None adds none. The first occurrence of a window is the one with the least id, null ids last,
    then the least hash of the text (``xxhash64``), then the least position. Rows that repeat both id
    and text are one document: they lose the same lines. Texts of fewer than three lines, null and
    empty texts stay as they are. A text that loses all lines becomes empty. Very long texts are
    treated whole. Other columns may have any name, be repeated or hold dots. An empty table gives an
    empty one.
    """
    prepare(df.sparkSession)
    rows, i, t = positional(df), position(df, id_col), position(df, text_col)
    gone = repeated_positions(rows, i, t)
    joined = rows.join(small_or_hashed(gone), (F.xxhash64(rows[t]) == gone["h"]) & rows[i].eqNullSafe(gone["id"]), "left")
    kept = [(f"c{k}", c) for k, c in enumerate(df.columns) if c != removed_col]
    names = [p for p, _ in kept] + ["n"] * (removed_col is not None)
    given = joined.select(*[rows[p] for p, _ in kept], F.lit(0).alias("n"), gone["at"])
    schema = given.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, t):
                at = part.column("at")
                hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False)).tolist()
                columns = {c: part.column(c) for c in names}
                if hit:
                    texts, n = part.column(t).to_pylist(), np.zeros(part.num_rows, np.int32)
                    for j in hit:
                        lines = texts[j].split("\n")
                        keep = np.ones(len(lines), bool)
                        pos = np.array(at[j].as_py())
                        for k in range(WINDOW):
                            keep[pos + k] = False
                        n[j] = len(lines) - keep.sum()
                        texts[j] = "\n".join([lines[x] for x in np.flatnonzero(keep).tolist()])
                    columns[t] = pa.array(texts, part.column(t).type)
                    if removed_col:
                        columns["n"] = pa.array(n)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return given.mapInArrow(run, schema).toDF(*[c for _, c in kept], *[removed_col] * (removed_col is not None))
