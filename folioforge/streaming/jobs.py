"""States of batch jobs as a stream: every job is delivered once, when it ends or when its time is up.

Jobs are kept in groups, thousands of them in one state, so that a call of Python
handles many; a group's state is a table of its open and recently ended jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.batchapi import job_status

_OUT = "name string, status string, at_us bigint"
_STATE = "jobs binary"
#: Groups of jobs; a checkpoint belongs to one number of them.
GROUPS = 1024


def _packed(jobs: pd.DataFrame) -> bytes:
    table = pa.Table.from_arrays([pa.array(jobs["name"], pa.string()), pa.array(jobs["first"], pa.int64()), pa.array(jobs["done"], pa.bool_())], ["name", "first", "done"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> pd.DataFrame:
    if data is None:
        return pd.DataFrame({"name": pd.Series([], dtype=object), "first": np.zeros(0, np.int64), "done": np.zeros(0, bool)})
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _watch(limit: int, keep: int):
    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = _unpacked(state.get[0] if state.exists else None)
        new = [] if state.hasTimedOut else list(batches)
        rows = pd.concat(new) if new else pd.DataFrame({"name": [], "at": np.zeros(0, np.int64), "status": []})
        now = state.getCurrentWatermarkMs()
        # every observation with its job's number and first time; a new job begins with its earliest one
        first = rows.groupby("name", sort=False)["at"].min()
        fresh = first[~first.index.isin(jobs["name"])]
        jobs = pd.concat([jobs, pd.DataFrame({"name": fresh.index, "first": fresh.to_numpy(np.int64), "done": np.zeros(len(fresh), bool)})], ignore_index=True)
        number = pd.Index(jobs["name"]).get_indexer(rows["name"])
        due, done = jobs["first"].to_numpy(np.int64) + limit, jobs["done"].to_numpy(bool)
        # the earliest observation that ends an open job: a final state, or any beyond its limit; then by status, as rows of one time are sorted
        at, status = rows["at"].to_numpy(np.int64), rows["status"].to_numpy(object)
        ends = np.flatnonzero(~done[number] & ((status != "pending") | (at > due[number])))
        found = pd.DataFrame({"job": number[ends], "at": at[ends], "status": status[ends]}).sort_values(["job", "at", "status"]).drop_duplicates("job")
        late = found["at"].to_numpy(np.int64) > due[found["job"]]
        over = ~done & (due // 1000 < now)
        over[found["job"]] = False
        over = np.flatnonzero(over)
        out = pd.DataFrame({
            "name": jobs["name"].to_numpy(object)[np.concatenate([found["job"].to_numpy(np.int64), over])],
            "status": np.concatenate([np.where(late, "expired", found["status"].to_numpy(object)), np.full(len(over), "expired", object)]),
            "at_us": np.concatenate([np.where(late, due[found["job"]], found["at"].to_numpy(np.int64)), due[over]]).astype(np.int64),
        })
        done[found["job"]] = done[over] = True
        # a job is forgotten once its time to be kept is over
        until = (due + np.where(done, keep, 0)) // 1000
        kept = np.flatnonzero(~done | (until >= now))
        if len(kept):
            state.update((_packed(jobs.assign(done=done).iloc[kept]),))
            state.setTimeoutTimestamp(max(int(until[kept].min()), now) + 1)
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    return follow


def finished_jobs(states: DataFrame, name: Column, state: Column, time: Column, limit_seconds: int, delay: str = "1 hour", keep_seconds: int = 7 * 86400) -> DataFrame:
    """name, status and at_us (microseconds) of every job, once: succeeded or failed at its first final state, or expired.

    states is a stream of observed job states. A job that has no final state up to limit_seconds after its first
    observation expires at that time, as soon as the watermark (delay behind the latest time) or a later observation of its own passes it.
    Observations after the end, repeated or not, change nothing; a job's state is dropped keep_seconds after its limit.
    Rows without a name or a time are left out, a null state is pending. Output is appended; a restarted query goes on from its checkpoint.
    """
    status = F.coalesce(job_status(state), F.lit("pending"))
    rows = states.select(name.cast("string").alias("name"), time.cast("timestamp").alias("time"), status.alias("status")).where("name is not null and time is not null")
    keyed = rows.withWatermark("time", delay).withColumn("at", F.unix_micros("time")).withColumn("jobs", F.pmod(F.xxhash64("name"), F.lit(GROUPS)).cast("int"))
    return keyed.groupBy("jobs").applyInPandasWithState(_watch(limit_seconds * 1_000_000, keep_seconds * 1_000_000), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
