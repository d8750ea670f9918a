"""Console and file sinks for bounded and unbounded lines."""

from __future__ import annotations

from pyspark.sql import DataFrame


def print_lines(lines: DataFrame, rows: int = 1000, trigger: dict | None = None):
    """Show bounded lines; for a stream, start a console query and return it."""
    if not lines.isStreaming:
        lines.show(rows, truncate=False)
        return None
    out = lines.writeStream.format("console").outputMode("append").option("truncate", False).option("numRows", rows)
    return out.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def write_lines(lines: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None):
    """Write lines as text files, replacing bounded ones; for a stream, start the query and return it."""
    if not lines.isStreaming:
        lines.write.mode("overwrite").text(path)
        return None
    if not checkpoint:
        raise ValueError("a file sink of a stream needs a checkpoint folder")
    out = lines.writeStream.format("text").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def drain(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that its source holds now, into Parquet, and read the result back.

    Windows that the watermark hasn't passed stay open, as streams have no end; bounded data belong in batch.
    """
    query = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
