"""Keeping an index in step with a stream of changes (op, id, vec, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecspark.operators.index import VectorIndex

#: The change feed: I, U or D; the row's id; its new vector; a number that grows with every change.
CHANGE_SCHEMA = "op string, id long, vec array<float>, seq long"


class CdcDisabled(RuntimeError):
    """The engine was told not to follow changes."""


def follow(index: VectorIndex, changes: DataFrame, checkpoint: str, *, available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Start a query that applies each micro-batch to the index.

    The highest applied ``seq`` is committed with the data, so a batch that is replayed after a failure
    changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        index.apply_changes(batch)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
