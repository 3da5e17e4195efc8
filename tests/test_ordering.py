"""Row numbers, running totals and ranks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import dataset, ordering


def test_ordinals_over_many_partitions(spark):
    rows = spark.range(5000).select(F.format_string("%06d", (F.col("id") * 7919) % 5000).alias("id"), F.lit("x").alias("ordinal"), F.lit("kept").alias("_place")).repartition(16)
    got = ordering.with_ordinal(rows).collect()
    assert sorted(r.ordinal for r in got) == list(range(5000)) and all(r.ordinal == int(r.id) and r._place == "kept" for r in got)
    assert ordering.with_ordinal(rows.select("id")).count() == 5000


def test_ordinals_of_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("b",), (None,), ("a",), ("b",), (None,)], "k string")
    got = sorted((r.ordinal, r.k) for r in ordering.ordinals(rows, "k").collect())
    assert got == [(0, "a"), (1, "b"), (2, "b"), (3, None), (4, None)]
    assert [r.ordinal for r in ordering.ordinals(rows, F.col("k").desc()).where("k = 'a'").collect()] == [2]
    assert ordering.ordinals(rows.limit(0), "k").count() == 0


def test_running_total(spark):
    random.seed(3)
    values = [(i, random.choice([None, 0, 1, 5, 1 << 40]), i) for i in range(3000)]
    rows = spark.createDataFrame(random.sample(values, len(values)), "k long, v long, before long").repartition(9)
    total, want = 0, {}
    for k, v, _ in values:
        want[k] = total
        total += v or 0
    assert {r.k: r.before for r in ordering.running_total(rows, F.col("v"), "k").collect()} == want
    assert ordering.running_total(rows.limit(0), F.col("v"), "k").count() == 0


def test_kth_keys(spark):
    keys = spark.range(3000).select(F.concat(F.md5(F.col("id").cast("string")), F.col("id").cast("string")).alias("key"))
    want = sorted(r.key for r in keys.collect())
    assert ordering.kth_keys(keys, "key", [0, 1, 1499, 2999, 1499], digits=1) == [want[i] for i in (0, 1, 1499, 2999, 1499)]
    assert ordering.kth_keys(keys.union(keys).union(keys.limit(1)), "key", [1]) == [want[0]]
    with pytest.raises(ValueError):
        ordering.kth_keys(keys, "key", [3000])


def test_no_window_and_no_exchange_over_rows_with_texts(spark):
    rows = spark.range(500).select(F.format_string("%06d", "id").alias("id"), F.repeat(F.lit("text "), 50).alias("text"))
    plan = dataset.assign_noise(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    numbered = ordering.with_ordinal(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert all("text" not in line for line in numbered.splitlines() if "Window" in line)


def test_quotas_are_exact_with_null_and_clashing_columns(spark):
    rows = spark.range(100).select(F.when(F.col("id") > 0, F.format_string("%06d", "id")).alias("id"), F.col("id").alias("ordinal"), F.lit(1).alias("_total"))
    got = dataset.assign_noise(rows)
    assert {r.noise_type: r["count"] for r in got.groupBy("noise_type").count().collect()} == {0: 40, 1: 30, 2: 30} and "ordinal" in got.columns
