"""Sinks: JSON lines, pretty records, one file per row, id lists, sharded datasets; all fail where output exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_total
from .file_sink import write_files


def json_lines(df: DataFrame, path: str, keep_nulls: bool = True) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("value")).write.mode("errorifexists").text(path)


def pretty_json(df: DataFrame, path: str, key: str) -> None:
    """One indented record per row, as a text column beside its key."""
    df.select(F.col(key).alias("key"), F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").parquet(path)


def key_values(df: DataFrame, path: str, key: str, value: str) -> None:
    """Side texts, HTML or bytes as a table partitioned by the key's first three characters."""
    df.select(F.col(key).alias("key"), F.col(value).alias("value"), F.substring(key, 1, 3).alias("shard")).write.mode("errorifexists").partitionBy("shard").parquet(path)


def files(df: DataFrame, folder: str, name: str, value: str, pretty: bool = False) -> None:
    """One file per row, committed as a whole; an existing file is an error (see file_sink)."""
    write_files(df, folder, name, value, pretty)


def id_list(df: DataFrame, path: str, key: str = "id") -> None:
    df.select(F.col(key).cast("string")).write.mode("errorifexists").text(path)


def dataset(df: DataFrame, path: str, max_records: int = 100_000) -> None:
    """Published splits: one folder each, files bounded by records."""
    df.write.mode("errorifexists").partitionBy("split").option("maxRecordsPerFile", max_records).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """The bytes of a row's values: lengths of texts, bytes and arrays of numbers, eight for any other value, one for a null."""
    size = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        own = F.octet_length(column) if kind in ("string", "binary") else 8 * F.size(column) if kind.startswith("array<") else F.lit(8)
        size = size + F.coalesce(F.when(column.isNotNull(), own), F.lit(1))
    return size


def shard_numbers(df: DataFrame, key: str, limit: int, split: str = "split", size: Column | None = None) -> DataFrame:
    """split, key, bytes and shard (from 0 in each split) of every row: shards take rows in order of the key, each about limit bytes (by size, or row_bytes of all columns).

    A row belongs to the shard in which its first byte falls, so a shard differs from the limit by less than a row at either end.
    Only keys and sizes are sorted, by ranges. Keys should be unique; a key of several rows may stand on both sides of a border.
    """
    narrow = df.select(F.col(f"`{split}`").alias("split"), F.col(f"`{key}`").alias("key"), (row_bytes(df) if size is None else size).alias("bytes"))
    placed = running_total(narrow, F.col("bytes"), "split", "key")
    first = placed.groupBy("split").agg(F.min("before").alias("first")).withColumnRenamed("split", "of")
    rows = placed.join(first, F.col("split").eqNullSafe(F.col("of")))
    return rows.select("split", "key", "bytes", F.floor((F.col("before") - F.col("first")) / limit).cast("int").alias("shard"))


def sharded_dataset(df: DataFrame, path: str, key: str, limit: int = 1 << 30, split: str = "split") -> None:
    """Published splits in shards bounded by bytes, rows in order of a unique key: path/split=.../shard=.../ holds one file each."""
    numbers = shard_numbers(df, key, limit, split).select(F.col("key").alias("shard_key"), "shard")
    rows = df.join(numbers, F.col(f"`{key}`") == F.col("shard_key")).drop("shard_key")
    rows.repartition(split, "shard").sortWithinPartitions(split, "shard", key).write.mode("errorifexists").partitionBy(split, "shard").parquet(path)


def ordered_json_lines(df: DataFrame, path: str, *order: str, keep_nulls: bool = True) -> None:
    """JSON lines whose files, by name, hold the rows in order."""
    value = F.to_json(F.struct("*"), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("value")
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(value).write.mode("errorifexists").text(path)
