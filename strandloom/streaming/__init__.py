"""Streams.

No operator here needs state, watermarks or event time. Column functions (coordinates, distances,
weights, name parsing) work on a streaming DataFrame as they stand; table operators, such as overlap
joins with a fixed annotation or the projection of new cells with a fitted LSI, run per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def per_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str) -> DataStreamWriter:
    """Writer that applies a table operator to every micro-batch and stores each batch's result
    under its own number, so a replayed batch overwrites itself."""

    def store(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(store)
