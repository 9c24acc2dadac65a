"""Streams written to the history of findings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def append_to_history(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    on_batch: Callable[[DataFrame, int], None] | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Append each micro-batch to a folder of its stream (named by its checkpoint) and batch number.

    A batch that is run again after a failure overwrites its own folder, so no row is
    written twice; another stream, or one begun anew with another checkpoint, never writes there. `on_batch` may push alerts.
    """

    stream_id = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/stream={stream_id}/batch={number}"
        batch.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").format(fmt).save(target)
        if on_batch is not None:
            on_batch(batch, number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
