"""Incremental upkeep of derived tables, as batches or as a stream of new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tarnwick.sources.tables import append_missing


def keep_extracted(stream: DataFrame, cache: str, make: Callable[[DataFrame], DataFrame], checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Extracts what the cache lacks from each micro-batch of (paper_id, ...) and appends it.

    An id that came before, in an earlier batch or run, is not extracted again, so replays change nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        append_missing(rows.dropDuplicates(["paper_id"]), cache, make)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
