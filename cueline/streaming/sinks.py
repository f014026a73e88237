"""Sinks of streams, of which each batch leaves one copy however often it is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.sources import files


def batch_writer(path: str, form: Callable[[DataFrame], DataFrame] | None = None, kind: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: a batch is written to a folder named after its id, in place of what an earlier try left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        made = form(batch) if form else batch
        made.write.mode("overwrite").format(kind).save(f"{path}/batch={batch_id}")

    return write


def event_stream_writer(path: str, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """Each row as a server-sent event, in text files (whose lines end with the second line feed)."""
    return batch_writer(path, lambda batch: files.format_event_stream(batch, columns).select(F.expr("left(value, length(value) - 1)").alias("value")), "text")


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 3600, mode: str = "append") -> None:
    """Run a stream over all that there is now; an error, or no end within ``seconds``, is an exception."""
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(seconds):
            raise TimeoutError(f"the stream had not ended after {seconds} seconds")
    finally:
        query.stop()
