"""Jobs share states: their number stays bounded, however many jobs there are."""

from pyspark.sql import functions as F

from folioforge.streaming import jobs


def test_many_jobs_share_few_states(spark, tmp_path):
    n = 3 * jobs.GROUPS
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 7)
    rows = spark.range(n).select(F.concat(F.lit("j"), "id").alias("name"), F.when(F.col("id") % 2 == 0, "JOB_STATE_SUCCEEDED").otherwise("JOB_STATE_RUNNING").alias("state"), at.alias("ts"))
    later = spark.createDataFrame([("z", None, 1_704_967_200)], "name string, state string, s long").select("name", "state", F.timestamp_seconds("s").alias("ts"))
    for part in (rows, later):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        found = jobs.finished_jobs(stream, F.col("name"), F.col("state"), F.col("ts"), 3600, "10 minutes", keep_seconds=3600)
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        kept = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
        assert kept <= jobs.GROUPS
    assert kept == 1  # all jobs but the last one are forgotten
    got = {r["status"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("status").count().collect()}
    assert got == {"succeeded": n // 2, "expired": n // 2}
