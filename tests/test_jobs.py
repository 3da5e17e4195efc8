"""Job states as a stream: restarts, repeats, time-outs."""

from pyspark.sql import functions as F

from folioforge.streaming.jobs import finished_jobs
from folioforge.streaming.resume import run_once

KIND = "name string, state string, minute int"
ZERO = 1_704_067_200_000_000  # 2024-01-01
RUN, OK, BAD = "JOB_STATE_RUNNING", "JOB_STATE_SUCCEEDED", "JOB_STATE_CANCELLED"


def test_every_job_is_delivered_once_over_restarts(spark, tmp_path):
    batches = [
        [("a", RUN, 0), ("a", OK, 5), ("b", RUN, 1), ("c", None, 2), ("c", RUN, 2), (None, OK, 3), ("d", OK, 4), ("d", BAD, 6), ("n", OK, None)],
        [("a", OK, 70), ("b", BAD, 50), ("c", RUN, 61), ("e", RUN, 65), ("d", OK, 66)],
        [("c", OK, 63), ("e", RUN, 300), ("f", RUN, 290), ("f", OK, 295)],
        [],
    ]
    seen = []
    for k, rows in enumerate(batches):
        time = (F.lit(ZERO) + F.col("minute").cast("bigint") * 60_000_000)
        spark.createDataFrame(rows, KIND).withColumn("ts", F.timestamp_micros(time)).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("name string, state string, minute int, ts timestamp").parquet(f"{tmp_path}/in")
        run_once(finished_jobs(stream, F.col("name"), F.col("state"), F.col("ts"), 3600, "10 minutes", keep_seconds=86_400), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        rows = spark.read.schema("name string, status string, at_us bigint").parquet(f"{tmp_path}/out").collect()
        seen.append({(r.name, r.status, (r.at_us - ZERO) / 60_000_000) for r in rows})
        assert len(rows) == len(seen[-1])
    assert seen[0] == {("a", "succeeded", 5), ("d", "succeeded", 4)}
    # c is due at 62; its state of 61 says nothing, and the watermark of 60 is not there yet
    assert seen[1] == seen[0] | {("b", "failed", 50)}
    # the late success of c is beyond its limit; e is due at 125
    assert seen[2] == seen[1] | {("c", "expired", 62), ("e", "expired", 125), ("f", "succeeded", 295)}
    assert seen[3] == seen[2]
