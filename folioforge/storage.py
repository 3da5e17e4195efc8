"""Tables in the folder that driver and executors share: they cut lineage and fix what later steps read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Setting under which Spark removes an execution's shuffle files at its end.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    Taken from spark.checkpoint.dir; only where that is unset on a local master
    (tests) a temporary folder is chosen and registered as the checkpoint folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folioforge-shared-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/") if "://" in found or found.startswith("file:") else "file://" + found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder, below a folder of this application."""
    return f"{shared_dir(spark)}/folioforge-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and reread it.

    Unlike checkpoint() this computes the plan once, compresses by column and
    lets later reads prune columns; unlike localCheckpoint it survives lost executors.
    The shuffle files of the write go when it ends, since nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> None:
    """Delete what this application's operators left in the shared folder, once their results are stored elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/folioforge-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3 or gs) or of a local path."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))
