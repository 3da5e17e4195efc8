"""Collation for supervised fine-tuning over token arrays, and prediction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import drop_first, mask_prefix, mask_special, pad_to


def collate(rows: DataFrame, marker: list[int], special: list[int], pad: int, bos: int | None = None, batch_col: str = "batch") -> DataFrame:
    """batch, input_ids, attention_mask, labels of rows (id, batch, ids).

    A doubled begin token is dropped where every row of the batch has it; rows are
    padded to the longest of their batch; labels ignore padding, special tokens and
    everything up to the first answer marker. Rows without a marker have null labels.
    """
    groups = rows.groupBy(batch_col).agg(F.max(F.size("ids")).alias("_n"), *([F.bool_and((F.get("ids", F.lit(0)) == bos) & (F.get("ids", F.lit(1)) == bos)).alias("_twice")] if bos is not None else [F.lit(False).alias("_twice")]))
    joined = rows.join(groups, batch_col).withColumn("ids", F.when(F.col("_twice"), drop_first(F.col("ids"))).otherwise(F.col("ids")))
    length = F.col("_n") - F.col("_twice").cast("int")
    padded = joined.withColumn("input_ids", pad_to(F.col("ids"), length, pad))
    mask = F.transform("input_ids", lambda v, i: (i < F.size("ids")).cast("int"))
    return padded.select("id", batch_col, "input_ids", mask.alias("attention_mask"), mask_prefix(mask_special(F.col("input_ids"), [pad, *special]), F.col("input_ids"), marker).alias("labels"))


def generated_suffix(output: Column, prompt: Column) -> Column:
    """What a model added behind its prompt."""
    return F.slice(output, F.size(prompt) + 1, F.greatest(F.size(output) - F.size(prompt), F.lit(0)))
