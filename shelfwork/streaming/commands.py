"""Commands that arrive as a stream, applied in micro-batches to versioned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def apply_stream(commands: DataFrame, state: Callable[[SparkSession], DataFrame], change: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], save: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``change`` (one of the batch functions) gives (new table, rejects) of the current ``state`` and a micro-batch;
    ``save`` writes both with the batch's number, by which a repeated batch can be told."""

    def run(batch: DataFrame, number: int) -> None:
        table, rejects = change(state(batch.sparkSession), batch)
        save(table, rejects, number)

    return commands.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
