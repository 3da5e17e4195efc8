"""Column functions over token arrays: search, label masks, padding."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def windows(ids: Column, k: int) -> Column:
    """All slices of k neighbours."""
    return F.when(F.size(ids) >= k, F.transform(F.sequence(F.lit(1), F.size(ids) - (k - 1)), lambda i: F.slice(ids, i, k))).otherwise(F.array().cast("array<array<int>>"))


def subsequence_positions(ids: Column, target: list[int]) -> Column:
    """0-based starts of every occurrence of target."""
    k = len(target)
    starts = F.when(F.size(ids) >= k, F.sequence(F.lit(0), F.size(ids) - k)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: reduce(and_, [F.get(ids, i + j) == t for j, t in enumerate(target)]))


def mask_special(ids: Column, special: list[int]) -> Column:
    return F.transform(ids, lambda v: F.when(v.isin(special), IGNORE).otherwise(v))


def mask_prefix(labels: Column, ids: Column, marker: list[int]) -> Column:
    """Ignore everything up to and including the first marker; null where there is none."""
    # bound once per row: inside the inner lambda the search would run for every element
    first = F.array(F.array_min(subsequence_positions(ids, marker)))
    masked = lambda f: F.when(f.isNotNull(), F.transform(labels, lambda v, i: F.when(i < f + len(marker), IGNORE).otherwise(v)))
    return F.get(F.transform(first, masked), F.lit(0))


def drop_first(ids: Column) -> Column:
    return F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))


def pad_to(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), (length - F.size(ids)).cast("int")))
