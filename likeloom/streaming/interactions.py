"""Streamed interactions, flattened and written batch by batch.

What the queue of a service does with a size and an interval is the trigger and the source's admission
(files, offsets) of a stream here. A batch that fails is done again, not dropped, and overwrites what it
had written; when a query is stopped, what came in is in the source still.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.interactions import action_rows, flattened, interaction_rows
from ..schema import INTERACTIONS


class BatchWriter(Protocol):
    def write(self, rows: DataFrame, actions: DataFrame, number: int) -> None: ...


class ParquetBatches:
    """Rows and actions as Parquet in a folder for each batch."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: DataFrame, actions: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/interactions/batch={number}")
        actions.write.mode("overwrite").parquet(f"{self.folder}/actions/batch={number}")


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 200) -> DataFrame:
    """Requests of interactions as they arrive in a folder, as JSON lines."""
    return spark.readStream.schema(INTERACTIONS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def persist(sent: DataFrame, feeds: DataFrame, ever: DataFrame, writer: BatchWriter, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Starts writing streamed requests; feeds and ever as in action_rows(). Without an interval all there is is written and the query ends."""

    def flush(batch: DataFrame, number: int) -> None:
        rows = interaction_rows(flattened(batch))
        writer.write(rows, action_rows(rows, feeds, ever), number)

    started = sent.writeStream.option("checkpointLocation", checkpoint).foreachBatch(flush)
    return started.trigger(processingTime=interval).start() if interval else started.trigger(availableNow=True).start()
