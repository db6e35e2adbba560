"""Optional streaming append into a ledger table: each micro-batch replaces rows of equal keys within the batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_stream(rows: DataFrame, folder: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append a stream's new rows to Parquet, once for each key of a micro-batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{folder}/batch={number}")  # a retried batch overwrites

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
