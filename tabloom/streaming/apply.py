"""Fitted steps on streams.

Cleaning, preprocessing and scoring are row-wise once fitted, so the batch ``transform`` runs on
a streaming frame unchanged. Fitting, splits and metrics need a whole table and stay batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabloom.errors import DataError
from tabloom.functions.storage import scratch_path


def apply_to_stream(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    *,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append transformed rows to a Parquet folder; restarts continue from the checkpoint.

    Without ``checkpoint`` a fresh one is made in the shared folder, for runs that need no restart.
    """
    if not stream.isStreaming:
        raise DataError("apply_to_stream needs a streaming frame; call the transform on a batch one.")
    writer = (
        transform(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "stream"))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
