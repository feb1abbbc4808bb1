"""Messages as a stream: each micro-batch is merged into the stored snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def follow(messages: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Calls ``merge`` with each micro-batch.  ``merge`` must give the same result when a batch comes
    again, as it does when it merges by note id and writes only what has changed."""
    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
