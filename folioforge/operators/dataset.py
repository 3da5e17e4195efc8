"""Dataset assembly: ground truth, exact quotas, routing, publication, key-set joins."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rng
from ..functions.text import strip
from .ordering import kth_keys

# Question, file names and folders by noise class.
QUESTION = "この画像内のテキストを日本語の読み順に従って全て出力してください。出力は画像内のテキストのみとしてください。"
NOISE_SUFFIX = {0: ".png", 1: "_scan.png", 2: "_augraphy.png"}
NOISE_DIR = {0: "image", 1: "image_noise_scan", 2: "image_noise_augraphy"}


def ground_truth(labels: DataFrame) -> DataFrame:
    """id and text: the shown title, then contents and captions in order, blank lines between, stripped."""
    part = F.transform("elements", lambda e: F.when(e["type"] == "text", e["content"]).when(e["type"] == "image", e["caption"]))
    joined = F.concat(F.when(F.col("show_title"), F.col("title")).otherwise(""), F.array_join(F.transform(F.filter(part, lambda p: p.isNotNull()), lambda p: F.concat(F.lit("\n\n"), p)), ""))
    return labels.select("id", strip(joined).alias("text"), "is_vertical", F.col("column_count").alias("num_columns"))


def assign_noise(rows: DataFrame, share: float = 0.3) -> DataFrame:
    """Exact quotas: floor(share * n) rows of class 1 and of class 2 in keyed random order, the rest class 0.

    The two keys at the quotas' borders are found first; rows then take their class by
    comparison, without a shuffle. Rows are told apart by id, so ids should be unique
    (rows of one id share a class); null ids count as empty ones.
    """
    ident = F.coalesce(F.col("id").cast("string"), F.lit(""))
    key = F.concat(rng.shuffle_key("noise", ident), ident)
    keys = rows.select(key.alias("key"))
    total = keys.count()
    quota = int(total * Fraction(str(share)))
    if not quota:
        return rows.withColumn("noise_type", F.lit(0))
    first, second = kth_keys(keys, "key", [total - 2 * quota, total - quota])
    return rows.withColumn("noise_type", F.when(key < first, 0).when(key < second, 1).otherwise(2))


def image_path(split: Column, noise: Column, doc_id: Column) -> Column:
    folder = F.when(noise == 0, NOISE_DIR[0]).when(noise == 1, NOISE_DIR[1]).otherwise(NOISE_DIR[2])
    suffix = F.when(noise == 0, NOISE_SUFFIX[0]).when(noise == 1, NOISE_SUFFIX[1]).otherwise(NOISE_SUFFIX[2])
    return F.concat_ws("/", split, folder, F.substring(doc_id, 1, 3), F.concat(doc_id, suffix))


def publish(rows: DataFrame) -> DataFrame:
    """The fixed published schema without pixels."""
    return rows.select("id", F.col("image_path").alias("image"), F.lit(QUESTION).alias("question"), "text", F.col("is_vertical").cast("boolean").alias("is_vertical"), F.col("num_columns").cast("int").alias("num_columns"), F.col("noise_type").cast("int").alias("noise_type"))


def union_splits(**splits: DataFrame) -> DataFrame:
    out = None
    for name, df in splits.items():
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def without(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done (left anti)."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def done_everywhere(key: str, *tables: DataFrame) -> DataFrame:
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.intersect(t.select(key))
    return out.distinct()


def require_all(rows: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """Rows with a status instead of a failed assertion: ok, or missing."""
    marked = needed.select(key).distinct().withColumn("folio_found", F.lit(True))
    return rows.join(marked, key, "left").withColumn("status", F.when(F.col("folio_found"), "ok").otherwise("missing")).drop("folio_found")
