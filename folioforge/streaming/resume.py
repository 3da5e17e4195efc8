"""Incremental batch: process new files once, by a checkpointed file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, file_format: str = "parquet") -> None:
    """Run transform over files that earlier calls have not seen, then stop."""
    stream = spark.readStream.schema(schema).format(file_format).load(source)
    query = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_once(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Take in what has come since the last call with this checkpoint, append the results to a table, stop."""
    stream.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
