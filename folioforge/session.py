"""SparkSession factory with the settings every query of this engine assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "folioforge", master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with AQE; keyword arguments (dots as ``__``) override settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FOLIOFORGE_DRIVER_MEMORY", "8g"))
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
