"""The batch operators behind a stream. Chunking keeps no state, so each micro-batch runs the batch code; deduplication and
counts keep state that a watermark bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archiveloom.operators.chunking import chunk


def stream_chunks(docs: DataFrame, path: str, checkpoint: str, strategy: str = "semantic", trigger: dict | None = None, **options) -> StreamingQuery:
    """Chunks of arriving documents, written to Parquet a micro-batch at a time. A batch that is tried again overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        chunk(batch, strategy, **options).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_first(rows: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key among those that arrive within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def stream_counts(rows: DataFrame, at: str, by: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows per window and kind, emitted once the watermark has passed."""
    frame = F.window(at, window, slide) if slide else F.window(at, window)
    return rows.withWatermark(at, late).groupBy(frame, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def to_memory(rows: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


Transform = Callable[[DataFrame], DataFrame]


def stream_transform(rows: DataFrame, transform: Transform, path: str, checkpoint: str) -> StreamingQuery:
    """Any stateless operator over arriving rows, into Parquet."""
    return transform(rows).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
