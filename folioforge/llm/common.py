"""Shared plumbing: shared-folder tables, Arrow batches, partition-stable row ids."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, remove_tables, save, shared_dir  # noqa: F401

#: Words of every text operator: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000, bytes_: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into pieces of bounded rows and roughly bounded bytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > bytes_:
                n //= 2
            yield batch.slice(at, n)
            at += n


def lean(run: Callable) -> Callable:
    """An Arrow function whose worker gives its memory back when a task ends, since workers outlive tasks and share a machine with the JVM."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def of_text(function: Callable, kind: str):
    """A column function of texts: function makes, per task, a function from an array of texts to an Arrow array. Only the text goes to Python."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            apply = function()
            for array in arrays:
                batch = pa.RecordBatch.from_arrays([array], names=["text"])
                yield pa.concat_arrays([apply(part.column(0)) for part in slices([batch])]) if len(array) else apply(array)
        finally:
            trim()

    return F.arrow_udf(run, kind)


def row_uid() -> int:
    """High bits of a row id that a retried task repeats: the partition's number."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 36


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))
