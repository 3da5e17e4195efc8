"""Connected components: contraction inside partitions, alternating with pointer jumps.

A contraction deals the edges by their larger end and replaces what hangs together
in a partition by a star around its least node; the same is done before the
shuffle, so that a node of any degree sends one edge a task. A jump takes every
edge past its smaller end to the least neighbour of that end. Each step that
changes an edge lowers the sum of all ends, so the rounds end by themselves; every
round is saved in the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, save

#: Edges that a task contracts at once.
CHUNK = 250_000
#: Parts into which the edges at one smaller end are dealt for a jump.
TURNS = 32


def contract(rows: list[tuple]) -> Iterator[tuple]:
    """Stars (node, least node, changed) of the components of edges (a, b, changed), b < a; unchanged are nodes whose only edge was the star's."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    told: dict = {}  # a node's only smaller end, or itself where there are several or the edge is new
    for a, b, changed in rows:
        told[a] = a if changed or told.get(a, b) != b else b
        up.setdefault(a, a), up.setdefault(b, b)
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    for x in up:
        least = root(x)
        if least != x:
            yield x, least, told.get(x) != least


def _stars(by_key: bool):
    """Contracts chunks of edges; by_key: the input is sorted by a, and edges of one a stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        schema = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*contract(rows))) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(columns)], names=["a", "b", "changed"])

        for batch in batches:
            schema = batch.schema
            held.extend(zip(*(c.to_pylist() for c in batch.columns)))
            if len(held) >= CHUNK:
                stop = len(held)
                while by_key and stop and held[stop - 1][0] == held[-1][0]:
                    stop -= 1
                if stop:
                    yield made(held[:stop])
                    held = held[stop:]
        if held:
            yield made(held)

    return run


def _contracted(edges: DataFrame) -> DataFrame:
    kind = edges.schema["a"].dataType.simpleString()
    form = f"a {kind}, b {kind}, changed boolean"
    local = edges.mapInArrow(lean(_stars(False)), form)
    return save(local.repartition("a").sortWithinPartitions("a").mapInArrow(lean(_stars(True)), form), "edges")


def _jumped(edges: DataFrame) -> DataFrame:
    """Edges (a, b, changed) past smaller ends that have smaller neighbours themselves."""
    least = edges.groupBy("a").agg(F.min("b").alias("up"))
    inner = edges.select("b").distinct().join(least, F.col("b") == F.col("a")).select("b", "up")
    turn = F.pmod(F.xxhash64("a"), F.lit(TURNS)).cast("int").alias("turn")
    wide = inner.select("b", "up", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("turn"))
    return edges.select("a", "b", turn).join(wide, ["b", "turn"], "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("changed"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of edges (a, b).

    Self-loops and repeated edges are allowed; null ends are ignored; no edges
    give no rows. Both ends are of one type: integers or strings.
    """
    real = edges.where("a is not null and b is not null and a <> b")
    now = _contracted(real.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(False).alias("changed")))
    first = True
    while not (now.limit(1) if first else now.where("changed")).isEmpty():
        first = False
        now = _contracted(_jumped(now))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
