"""Scans: tables, JSON lines, nested documents, whole texts, id lists, image bytes, directory listings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSONL files; several files append. Rows have no order; ordered_json.ordered_json gives each its place."""
    return spark.read.schema(schema).json(path)


def json_documents(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    """One nested record per file; the path is kept."""
    reader = spark.read.schema(schema).option("multiLine", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path).withColumn("path", F.col("_metadata.file_path"))


def whole_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """path and value, one file per row."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), "value")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def images(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg}", recursive: bool = True) -> DataFrame:
    """path, length and content of image files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path).select("path", "length", "content")


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """Sorted paths below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path).select("path", "length").orderBy("path")


def job_results(jobs: DataFrame, download: Callable[[str], bytes]) -> DataFrame:
    """name and line of the results of finished jobs; download is a pluggable client."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(name, line) for name in b["name"] for line in download(name).decode().split("\n") if line.strip()]
            yield pd.DataFrame(rows, columns=["name", "line"])

    return jobs.where("state = 'JOB_STATE_SUCCEEDED'").select("name").mapInPandas(run, "name string, line string")
