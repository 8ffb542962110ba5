"""A stream of mutations into a log table, and the table's live view. Beyond the batch engine; state is the log itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import mutations


def append_log(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each micro-batch as Parquet; a batch that is retried overwrites its own folder, so entries arrive once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_view(log: DataFrame, order: list[str]) -> DataFrame:
    return mutations.live(log, order)
