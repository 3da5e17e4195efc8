"""Rolling window features: counts, sums, distinct kinds and exact ranks over the time before each event.

The values of a window are a multiset in an indexable skip list: every link knows
how many values it skips, so a rank is found by walking spans. Time is cut into
slices, and a slice gets the rows of the slices before it as its look-back; hence
one group's rows spread over as many tasks as there are slices.
"""

from __future__ import annotations

import random
from collections import Counter, deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, table
from .periodic_runs import crc32_sql


class SkipList:
    """A multiset of numbers in order, with insertion, removal and the value of a rank in logarithmic expected time.

    A node is [value, copies, next by level, span by level]; a span is the number of
    values behind the node up to and including the next one of that level.
    """

    LEVELS = 16

    def __init__(self) -> None:
        self.head = [None, 0, [None] * self.LEVELS, [0] * self.LEVELS]
        self.top, self.size = 1, 0
        self.random = random.Random(5).random

    def _before(self, value) -> tuple[list, list[int]]:
        """By level, the last node below value and the number of values up to it."""
        node, rank, nodes, ranks = self.head, 0, [self.head] * self.LEVELS, [0] * self.LEVELS
        for level in range(self.top - 1, -1, -1):
            after = node[2][level]
            while after is not None and after[0] < value:
                rank += node[3][level]
                node, after = after, after[2][level]
            nodes[level], ranks[level] = node, rank
        return nodes, ranks

    def insert(self, value) -> None:
        nodes, ranks = self._before(value)
        found, height = nodes[0][2][0], 0
        if found is not None and found[0] == value:
            found[1] += 1
        else:
            height = 1
            while height < self.LEVELS and self.random() < 0.25:
                height += 1
            while self.top < height:  # links of a new level reach to the end
                self.head[3][self.top] = self.size
                self.top += 1
            new = [value, 1, [None] * height, [0] * height]
            for level in range(height):
                node, skipped = nodes[level], ranks[0] - ranks[level]
                new[2][level], node[2][level] = node[2][level], new
                new[3][level], node[3][level] = node[3][level] - skipped, skipped + 1
        for level in range(height, self.top):
            nodes[level][3][level] += 1
        self.size += 1

    def remove(self, value) -> None:
        """Take one copy of value out; it must be there."""
        nodes, _ = self._before(value)
        found, height = nodes[0][2][0], 0
        if found[1] > 1:
            found[1] -= 1
        else:
            height = len(found[2])
            for level in range(height):
                node = nodes[level]
                node[2][level] = found[2][level]
                node[3][level] += found[3][level] - 1
        for level in range(height, self.top):
            nodes[level][3][level] -= 1
        self.size -= 1

    def at(self, rank: int):
        """The value of a rank, counted from 1."""
        node = self.head
        for level in range(self.top - 1, -1, -1):
            while node[2][level] is not None and node[3][level] < rank:
                rank -= node[3][level]
                node = node[2][level]
        return node[2][0][0]


class Window:
    """The rows of the last seconds before a time."""

    def __init__(self, seconds: int, begin: int):
        self.seconds, self.begin = seconds, begin - seconds
        self.rows, self.values, self.kinds, self.total = deque(), SkipList(), Counter(), 0

    def expire(self, now: int) -> None:
        while self.rows and self.rows[0][0] < now - self.seconds:
            _, value, kind = self.rows.popleft()
            if value is not None:
                self.values.remove(value)
                self.total -= value
            if kind is not None:
                self.kinds[kind] -= 1
                if not self.kinds[kind]:
                    del self.kinds[kind]

    def insert(self, time: int, value, kind) -> None:
        if time < self.begin:  # look-back of a longer window
            return
        self.rows.append((time, value, kind))
        if value is not None:
            self.values.insert(value)
            self.total += value
        if kind is not None:
            self.kinds[kind] += 1

    def features(self, shares: Sequence[tuple[int, int]]) -> tuple:
        m = self.values.size
        return (len(self.rows), self.total, len(self.kinds), *[self.values.at(-(-num * m // den)) if m else None for num, den in shares])


def _slide(windows: Sequence[int], shares: Sequence[tuple[int, int]], span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_, group = None, [], []

        def close() -> list[tuple]:
            """The rows of one time see the windows before any of them enters; then they enter."""
            own, out = [r for r in group if r[5]], []
            for window in open_:
                window.expire(here[2])
                if own:
                    found = (window.seconds, here[2], *window.features(shares))
                    out += [(r[0], *found) for r in own]
                for r in group:
                    window.insert(here[2], r[3], r[4])
            return out

        kinds = [pa.int64()] * (6 + len(shares))
        names = ["id", "window_s", "event_s", "n_events", "total", "n_kinds", *[f"share_{k}" for k in range(len(shares))]]
        table_ = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        out: list[tuple] = []
        for batch in batches:
            ids, groups, slices, times, values, labels, own = (c.to_pylist() for c in batch.columns)
            for place in zip(groups, slices, times, ids, values, labels, own):
                if place[:3] != here:
                    if group:
                        out += close()
                    if here is None or place[:2] != here[:2]:
                        open_ = [Window(w, place[1] * span) for w in windows]
                    here, group = place[:3], []
                group.append((place[3], None, None, place[4], place[5], place[6]))
            if len(out) >= 10_000:
                yield table_(out)
                out = []
        if group:
            out += close()
        if out:
            yield table_(out)

    return run


def rolling_features(events: DataFrame, windows: Sequence[int], shares: Sequence[tuple[int, int]], id: Column, group: Column, time: Column, value: Column, kind: Column, slices: int = 4) -> DataFrame:
    """For every row and every window of w seconds: id, window_s, event_s, n_events, total, n_kinds and share_0, share_1, ...

    The window holds all rows of the row's group (null is one group) with event_s - w <= time < event_s, so rows
    of one time do not see each other. total sums the non-null values (0 if there are none), n_kinds counts distinct non-null kinds, and
    share (num, den) is the value of rank ceil(num * m / den) among the m non-null values in order, repeats kept (null if m = 0).
    ids, times in seconds and values are whole numbers. Rows without a time are in no window and see empty ones. Repeated rows count
    and are answered each on its own; other columns are left out. The longest window is cut into a number of slices; every row goes to its slice of time and to as many after it, so
    that a task has little more than the events of a group in the longest window, whatever the group's rows in all.
    """
    span = -(-max(windows) // slices)
    rows = events.select(id.cast("bigint").alias("id"), group.alias("group"), time.cast("bigint").alias("time"), value.cast("bigint").alias("value"), kind.alias("kind"))
    own = F.floor(F.col("time") / span).cast("bigint")
    dealt = rows.where("time is not null").withColumn("slice", F.explode(F.sequence(own, own + slices))).withColumn("own", F.col("slice") == own)
    sorted_ = dealt.select("id", "group", "slice", "time", "value", "kind", "own").repartition("group", "slice").sortWithinPartitions("group", "slice", "time")
    columns = "id bigint, window_s bigint, event_s bigint, n_events bigint, total bigint, n_kinds bigint, " + ", ".join(f"share_{k} bigint" for k in range(len(shares)))
    found = sorted_.mapInArrow(lean(_slide(windows, shares, span)), columns)
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    timeless = rows.where("time is null").select("id", F.explode(F.array(*[F.lit(w).cast("bigint") for w in windows])).alias("window_s"), none.alias("event_s"), zero.alias("n_events"), zero.alias("total"), zero.alias("n_kinds"), *[none.alias(f"share_{k}") for k in range(len(shares))])
    return found.unionByName(timeless)


def event_time(doc_id: Column) -> Column:
    """60 * floor((doc_id + crc32(doc_id) mod 1000) / 6), in whole numbers."""
    x = doc_id + F.crc32(doc_id.cast("string").cast("binary")) % 1000
    return (60 * ((x - F.pmod(x, F.lit(6))) / 6)).cast("bigint")


def op13_rolling_features(spark, sf_dir: str) -> DataFrame:
    docs, doc_id = table(spark, sf_dir, "documents"), F.col("doc_id").cast("bigint")
    found = rolling_features(docs, [1800, 86400], [(1, 2), (99, 100)], doc_id, F.col("source"), event_time(doc_id), F.length("text"), F.col("lang"))
    return found.select(F.col("id").alias("doc_id"), "window_s", "event_s", "n_events", F.col("total").alias("sum_chars"), F.col("n_kinds").alias("n_langs"), F.col("share_0").alias("median_chars"), F.col("share_1").alias("high_chars"))


ORACLE = f"""
with d as (select row_number() over () as r, doc_id, source, lang, length(text) as n, 60 * ((doc_id + {crc32_sql('doc_id::varchar')} % 1000) // 6) as event_s from documents),
w as (select unnest([1800, 86400]::bigint[]) as window_s),
j as (select a.r, any_value(a.doc_id) as doc_id, window_s, any_value(a.event_s) as event_s, count(b.r) as n_events, coalesce(sum(b.n), 0)::bigint as sum_chars,
  count(distinct b.lang) as n_langs, list_sort(list(b.n) filter (b.n is not null)) as l
  from d a cross join w left join d b on a.source is not distinct from b.source and b.event_s >= a.event_s - window_s and b.event_s < a.event_s group by a.r, window_s)
select doc_id, window_s, event_s, n_events, sum_chars, n_langs, l[(len(l) + 1) // 2] as median_chars, l[(99 * len(l) + 99) // 100] as high_chars from j
"""
