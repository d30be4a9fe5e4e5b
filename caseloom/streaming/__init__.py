"""Flows over streams: each micro-batch becomes an entity's value."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..flow import Flow
from ..values import FrameSource


def feed(
    flow: Flow, entity: str, stream: DataFrame, wanted: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger: Any
) -> StreamingQuery:
    """Sets ``entity`` to each micro-batch and gives the frame of ``wanted`` to ``sink`` with the batch's id.

    ``trigger`` is Spark's (``processingTime="1 minute"``); without one, what there is now is taken, and the stream ends.

    The stream's and the batch's ids name its value, so a batch that Spark repeats
    after a failure finds its stored results, and streams are told apart.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        # Spark keeps a stream's id in its checkpoint, over restarts.
        query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        sink(flow.setting(entity, FrameSource(df, version=f"batch-{query}-{batch_id}")).frame(wanted), batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
