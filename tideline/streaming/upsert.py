"""Micro-batches of a change stream into a versioned target, exactly once by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import first_rows, upsert
from ..sources.store import TargetStore


def upsert_batches(store: TargetStore, keys: Sequence[str], order: Sequence[Column]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: of a key's rows in a batch the first in the order counts. A batch that is
    replayed after a failure is skipped if the target has it already (`_batch`)."""

    def apply(batch: DataFrame, number: int) -> None:
        target = store.read()
        if target is not None and (target.agg(F.max("_batch")).first()[0] or -1) >= number:
            return
        staged = first_rows(batch, keys, order).withColumn("_batch", F.lit(number).cast("long"))
        store.write(staged if target is None else upsert(target, staged, keys))

    return apply


def stream_into(changes: DataFrame, store: TargetStore, keys: Sequence[str], order: Sequence[Column], checkpoint: str) -> StreamingQuery:
    """Takes all that is there, in batches, and ends."""
    return changes.writeStream.foreachBatch(upsert_batches(store, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
