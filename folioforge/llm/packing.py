"""Operator 6, best-fit packing by a configuration linear program.

Only the histogram of piece lengths reaches the driver: at most `capacity` rows,
whatever the input. There the covering LP over configurations (multisets of
lengths that fit one sequence) is solved by multiplicative weights: a length's
price is its share of a sequence times a weight that falls as it gets covered; a
knapsack dynamic program prices, in one pass, the best configuration with each
length; those near the best price and (at first wholly) full enter the solution
by a share of what is left of their scarcest length. The cover is rounded down, and
the same steps with whole amounts cover what rounding left; single pieces that no
round placed go best-fit. The prices' dual bound, a lower limit for any packing,
is reported beside the result. The result, intervals of ranks per length, is
applied to all pieces in one vectorised pass.

Defined cases: a null or empty text is one piece with the end id; a text longer
than the capacity is cut so that only its first piece may be shorter; repeated
rows and ids are packed each on its own; an empty table gives an empty result;
rows without an id keep a null id; other columns are not read. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, save, slices
from .tokenizing import crc32, encoder, tokenizer_path, with_end

CAPACITY = 2048
#: Rounds of prices for the fractional cover, and for the whole one.
ROUNDS = 120
#: Share of a length's uncovered pieces that a configuration takes in one round.
STEP = 0.25
#: How full configurations have to be; the next share holds once a round places little of what is left.
FILLS = (1.0, 0.9995, 0.998, 0.995, 0.99, 0.98, 0.95, 0.0)

#: Shares of the cover that are rounded, and the part of the fewest sequences that a greater share may cost.
SHARES, SLACK = (1.0, 0.9, 0.5, 0.1), 0.0005


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total value of lengths, with multiplicity, that fit each capacity up to this one, and the last length chosen (-1: none); by dynamic programming."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, np.int64)
    stops = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if stops[c]:
            totals = best[c - lengths[: stops[c]]] + values[: stops[c]]
            k = int(totals.argmax())
            if totals[k] > best[c]:
                best[c], choice[c] = totals[k], k
    return best, choice


def content_of(choice: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """Indices of the lengths, with multiplicity, of the best content of a capacity."""
    out: dict[int, int] = {}
    while capacity > 0:
        k = int(choice[capacity])
        if k < 0:
            capacity -= 1
        else:
            out[k] = out.get(k, 0) + 1
            capacity -= int(lengths[k])
    return out


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, whole: bool = False) -> tuple[dict[tuple, float], np.ndarray, float]:
    """Amounts of configurations (index, copies pairs), what they leave of each length, and the prices' dual bound; whole: whole amounts only."""
    left, out, bound, fill = counts.astype(float), {}, float((lengths * counts).sum()) / capacity, 0
    enough = 0.5 if whole else np.maximum(1e-3 * counts, 1e-6)
    for _ in range(rounds):
        bare = left > enough
        if not bare.any():
            break
        share = left / counts
        prices = np.where(bare, lengths / capacity * np.exp(share - share[bare].max()), 0.0)
        best, choice = knapsack(prices, lengths, capacity)
        bound = max(bound, float(counts @ prices) / best[capacity])  # prices by the best one are feasible for the dual
        placed = 0.0
        for k in np.argsort(-share, kind="stable").tolist():
            if left[k] <= (enough if whole else enough[k]) or prices[k] + best[capacity - lengths[k]] < (0.8 if fill < len(FILLS) - 1 else 0.0) * best[capacity]:
                continue
            content = content_of(choice, lengths, capacity - int(lengths[k]))
            content[k] = content.get(k, 0) + 1
            if sum(int(lengths[j]) * n for j, n in content.items()) < FILLS[fill] * capacity:
                continue
            amount = min(left[j] / n for j, n in content.items())
            amount = float(max(int(amount * STEP), min(1, int(amount)))) if whole else amount * STEP
            if amount > 0:
                key = tuple(sorted(content.items()))
                out[key] = out.get(key, 0.0) + amount
                for j, n in content.items():
                    left[j] -= n * amount
                placed += amount
        if placed < 0.002 * float((lengths * left)[bare].sum()) / capacity:
            if fill == len(FILLS) - 1 and not placed:
                break
            fill = min(fill + 1, len(FILLS) - 1)
    return out, left, bound


def _best_fit(groups: dict[int, list], length: int, n: int, capacity: int) -> None:
    """Place n pieces of a length into groups of equal bins, keyed by the room left; fullest bins first."""
    while n:
        room = next((r for r in range(length, capacity + 1) if groups.get(r)), None)
        if room is None:
            fit = capacity // length
            bins = n // fit
            if bins:
                groups.setdefault(capacity - fit * length, []).append(({length: fit}, bins))
            if n % fit:
                groups.setdefault(capacity - n % fit * length, []).append(({length: n % fit}, 1))
            return
        content, bins = groups[room].pop()
        used = min(bins, n)
        if bins > used:
            groups[room].append((content, bins - used))
        groups.setdefault(room - length, []).append(({**content, length: content.get(length, 0) + 1}, used))
        n -= used


@dataclass
class Solution:
    """Configurations (length -> copies) with their numbers of sequences, how many of those the linear program priced, and a lower limit for any packing."""

    packing: list[tuple[dict[int, int], int]]
    priced: int
    bound: float

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.packing)


def _rounded(lengths: np.ndarray, counts: np.ndarray, cover: dict[tuple, float], share: float, capacity: int, rounds: int) -> tuple[dict[tuple, int], int]:
    """Configurations (length, copies pairs) with whole amounts: a share of the fractional cover rounded down, with all of it whole amounts after, then best-fit. Also how many sequences were priced."""
    out: dict[tuple, int] = {}
    remain, priced = counts.copy(), 0

    def take(found: dict[tuple, float], at: np.ndarray, part: float) -> None:
        nonlocal priced
        for content, amount in found.items():
            if (times := int(amount * part)) > 0:
                for j, n in content:
                    remain[at[j]] -= n * times
                key = tuple((int(lengths[at[j]]), n) for j, n in content)
                out[key] = out.get(key, 0) + times
                priced += times

    take(cover, np.arange(len(lengths)), share)
    if share == 1 and len(at := np.flatnonzero(remain)):
        take(configurations(lengths[at], remain[at], capacity, rounds, True)[0], at, 1.0)
    groups: dict[int, list] = {}
    for k in range(len(lengths) - 1, -1, -1):
        if remain[k]:
            _best_fit(groups, int(lengths[k]), int(remain[k]), capacity)
    for content, bins in (m for members in groups.values() for m in members):
        key = tuple(sorted(content.items()))
        out[key] = out.get(key, 0) + bins
    return out, priced


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Solution:
    """Packing of a length histogram: the greatest share of the linear program's cover that comes within `SLACK` of the fewest sequences of any share."""
    out: dict[tuple, int] = {}
    priced, bound = 0, 0.0
    some = {x: n for x, n in histogram.items() if n and x < capacity}
    if some:
        lengths = np.array(sorted(some), np.int64)
        counts = np.array([some[int(x)] for x in lengths], np.int64)
        cover, _, bound = configurations(lengths, counts, capacity, rounds)
        tried = [_rounded(lengths, counts, cover, share, capacity, rounds) for share in SHARES]
        least = min(sum(t[0].values()) for t in tried)
        out, priced = next(t for t in tried if sum(t[0].values()) <= least + int(least * SLACK))
    if histogram.get(capacity):
        out[((capacity, 1),)] = histogram[capacity]
        priced, bound = priced + histogram[capacity], bound + histogram[capacity]
    return Solution([(dict(key), n) for key, n in sorted(out.items())], priced, bound)


def intervals(packing: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For every length the ranks that each configuration takes: arrays sorted by (length, first rank)."""
    rows, ranks, base = [], {}, 0
    for content, n in packing:
        offset = 0
        for length, copies in sorted(content.items(), reverse=True):
            at = ranks.get(length, 0)
            rows.append((length, at, base, copies, offset))
            ranks[length] = at + copies * n
            offset += copies * length
        base += n
    rows.sort()
    names = ("length", "rank", "base", "copies", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


_PIECES = "part long, doc_id long, piece int, start long, length long, ids_crc32 long, place long"


def _cutter(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            flat, counts = with_end(*enc.encode(batch.column(1)), end_id)
            ends = np.cumsum(counts)
            pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = counts - capacity * (pieces - 1)
            length = np.where(number == 0, first[owner], capacity)
            start = np.where(number == 0, 0, first[owner] + capacity * (number - 1))
            at = (ends - counts)[owner] + start
            crcs = [crc32(flat[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")  # place: how many pieces of this length the task had before
            ordered = length[order]
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([new, [len(ordered)]]))
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(ordered)) - np.repeat(new, sizes) + seen[ordered]
            np.add.at(seen, length, 1)
            ids = batch.column(0).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(owner), part)), ids, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64()), pa.array(place, pa.int64())], names=["part", "doc_id", "piece", "start", "length", "ids_crc32", "place"])

    return run


def _placer(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        keys = p["length"] << 44 | p["rank"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            index = rank - p["rank"][i]
            copies = p["copies"][i]
            sequence, offset = p["base"][i] + index // copies, p["offset"][i] + index % copies * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    pieces = save(rows.mapInArrow(lean(_cutter(tokenizer_path(tokenizer), capacity, end_id)), _PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(intervals(solve(histogram, capacity, rounds).packing))
    ranked = pieces.join(firsts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lean(_placer(plan)), out)
