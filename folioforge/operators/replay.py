"""Masking and replay of scanned pages: id list, images, metadata and noise log meet by id without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import new_path
from .noise import noisy_images


def bucketed(df: DataFrame, name: str, key: str = "id", buckets: int = 64) -> DataFrame:
    """Store df dealt by key into a fixed number of buckets, one file each; joins of tables stored alike need no exchange.

    The table lies in the shared folder under a name of its own. Every row is kept, null keys included.
    """
    spark = df.sparkSession
    table = f"folioforge_{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def replay_rows(ids: DataFrame, images: DataFrame, metadata: DataFrame, log: DataFrame) -> DataFrame:
    """The listed ids once each with the columns of images, metadata and log, and a status: ok, or missing and the parts that are.

    All four are tables by id (bucketed alike, so that they join where they lie); ids are unique in the three parts.
    """
    out, parts = ids.select("id").where("id is not null").dropDuplicates(["id"]), {"image": images, "metadata": metadata, "log": log}
    for name, part in parts.items():
        out = out.join(part.withColumn(f"has_{name}", F.lit(True)).hint("merge"), "id", "left")
    missing = F.concat_ws(",", *[F.when(F.col(f"has_{name}").isNull(), name) for name in parts])
    return out.withColumn("status", F.when(missing == "", "ok").otherwise(F.concat(F.lit("missing "), missing))).drop(*[f"has_{name}" for name in parts])


def mask_rects(elements: str, target: str = "img_cap") -> Column:
    """Rectangles of image elements to mask, in whole numbers: the image (its box has no text), the caption (its box has some) or both."""
    boxes = F.flatten(F.transform(F.filter(elements, lambda e: e["type"] == "image"), lambda e: F.coalesce(e["bboxes"], F.array())))
    kept = {"img": lambda b: b["text"] == "", "cap": lambda b: b["text"] != "", "img_cap": lambda b: F.lit(True)}[target]
    end = lambda b, at, size: F.floor(b[at] + b[size]).cast("int")
    return F.transform(F.filter(boxes, kept), lambda b: F.struct(F.floor(b["x"]).cast("int").alias("x1"), F.floor(b["y"]).cast("int").alias("y1"), end(b, "x", "width").alias("x2"), end(b, "y", "height").alias("y2"), b["text"].alias("text")))


def blue_green_red(color: Column) -> Column:
    """The bytes of a colour written #rgb or #rrggbb, as pixels have them."""
    long = F.when(F.length(color) == 4, F.regexp_replace(color, "([0-9a-fA-F])", "$1$1")).otherwise(color)
    return F.array(*[F.conv(F.substring(long, at, 2), 16, 10).cast("int") for at in (6, 4, 2)])


def replay(rows: DataFrame, target: str = "img_cap") -> DataFrame:
    """id and pixels of complete rows: targets are filled with the figures' background, then the logged noise is applied again."""
    rects = F.transform(mask_rects("elements", target), lambda r: F.struct(r["x1"].alias("x"), r["y1"].alias("y"), (r["x2"] - r["x1"]).alias("width"), (r["y2"] - r["y1"]).alias("height")))
    ready = rows.where("status = 'ok'").select("id", "width", "height", "pixels", "config", rects.alias("boxes"), blue_green_red(F.col("figure_bg_color")).alias("figure_color"))
    return noisy_images(ready)
