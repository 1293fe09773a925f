"""Structured Streaming into a store: each micro-batch is one atomic write, and an epoch is applied once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, to_batch: Callable[[DataFrame], DataFrame], order: list[str], checkpoint: str, name: str = "ingest", available_now: bool = True) -> StreamingQuery:
    """Write a stream's rows, made operations by to_batch, in the order of columns that say which came first. Rates
    are limited at the source (maxFilesPerTrigger); after a restart the store skips epochs that it has."""
    from pyspark.sql import functions as F

    columns: list[Column] = [F.col(c) for c in order]

    def write(df: DataFrame, epoch: int) -> None:
        store.write(to_batch(df), columns, (name, epoch))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
