"""Row numbers, running totals and ranks over whole tables, without a window over them.

Numbers need a total order, so a narrow table of keys is sorted by ranges and
stored; one count (and sum) per range partition then tells what lies before it.
Rows with texts only meet the finished numbers, by key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import save


def _ranged(narrow: DataFrame, order: tuple) -> DataFrame:
    by = [F.col(f"`{c}`").asc_nulls_last() if isinstance(c, str) else c for c in order]
    return narrow.repartitionByRange(*by).sortWithinPartitions(*by)


def _offsets(stored: DataFrame, part: Column, value: Column) -> DataFrame:
    """What lies before each range partition; their number is bounded by the session's partitions, not by rows."""
    sums = stored.groupBy(part.alias("part")).agg(value.alias("own"))
    before = F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0)).cast("bigint").alias("before"))


def ordinals(narrow: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """Adds the 0-based number of every row in the order given (names: ascending, nulls last).

    The table should be narrow: it is sorted by ranges and stored once. Rows of equal
    order get different numbers, in any order among themselves; a column called name is replaced.
    """
    columns = [c for c in narrow.columns if c != name]
    sorted_ = _ranged(narrow, order).select(F.struct(*[f"`{c}`" for c in columns]).alias("row"), F.monotonically_increasing_id().alias("id"))
    stored = save(sorted_, "ordinals")
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    offsets = _offsets(stored, part, F.count("*"))
    return stored.join(offsets, part == F.col("part")).select("row.*", (F.col("before") + place).alias(name))


def running_total(narrow: DataFrame, value: Column, *order: str | Column, name: str = "before") -> DataFrame:
    """Adds the sum of value over all rows before each row in the order given; null values add nothing."""
    columns = [c for c in narrow.columns if c != name]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            own = batch.column(1).to_numpy(zero_copy_only=False)
            sums = np.cumsum(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total + sums - own, pa.int64()), batch.column(2)], names=["row", "own", "inside", "part"])
            total += int(sums[-1]) if len(sums) else 0

    measured = narrow.select(*columns, F.coalesce(value.cast("bigint"), F.lit(0)).alias("folio_own"))
    sorted_ = _ranged(measured, order).select(F.struct(*[f"`{c}`" for c in columns]).alias("row"), F.col("folio_own").alias("own"), F.spark_partition_id().alias("part"))
    kind = sorted_.select("row").schema["row"].dataType.simpleString()
    stored = save(sorted_.mapInArrow(add, f"row {kind}, own bigint, inside bigint, part int"), "running_total")
    offsets = _offsets(stored, F.col("part"), F.sum("own"))
    return stored.join(offsets, "part").select("row.*", (F.col("before") + F.col("inside")).alias(name))


def with_ordinal(df: DataFrame, key: str = "id", name: str = "ordinal") -> DataFrame:
    """Numbers the rows of df in the order of a unique key; only keys are sorted, the rows join their number."""
    if df.columns == [key]:
        return ordinals(df, key, name=name)
    return df.drop(name).join(ordinals(df.select(key), key, name=name), key)


def kth_keys(keys: DataFrame, column: str, ranks: Sequence[int], digits: int = 3, alphabet: str = "0123456789abcdef") -> list[str]:
    """The keys of the given 0-based ranks in the order of a column of texts that start with spread digits (a digest).

    Each round counts keys by their next digits, only those that share a wanted rank's prefix:
    at most len(alphabet) ** digits counts a rank go to the driver. Rounds end where a prefix holds
    one key or the digest is used up; the key itself is then the least of its few rows.
    """
    found: dict[int, str] = {}
    open_ = {rank: ("", rank) for rank in ranks}
    while open_:
        prefixes = sorted({p for p, _ in open_.values()})
        size = len(prefixes[0])
        rows = keys.where(F.substring(column, 1, size).isin(prefixes)) if size else keys
        counts = rows.groupBy(F.substring(column, 1, size + digits).alias("prefix")).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).collect()
        following = {}
        for rank, (prefix, place) in open_.items():
            for row in sorted(r for r in counts if r["prefix"].startswith(prefix)):
                if place < row["n"]:
                    break
                place -= row["n"]
            else:
                raise ValueError(f"rank {rank} is beyond the keys")
            if row["n"] == 1 or row["least"] == row["most"]:
                found[rank] = row["least"]
            else:
                following[rank] = (row["prefix"], place)
        open_ = following
    return [found[rank] for rank in ranks]


def batch_id(ordinal: Column, size: int) -> Column:
    return F.floor(ordinal / size).cast("bigint")


def worker_chunk(ordinal: Column, total: Column, workers: int) -> Column:
    """Contiguous chunks of ceil(n / workers)."""
    size = F.floor((total + (workers - 1)) / workers)
    return F.floor(ordinal / size).cast("bigint")
