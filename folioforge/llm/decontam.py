"""Operator 2, benchmark decontamination with edited passages.

A document contains an item if some part of it is within an edit distance (in
words) of `rate` of the item's length. Item-sized windows pass three tests:

1. A lossless q-gram count: a part within e edits of an n-word item holds at
   least n - 1 - 2e of its n - 1 word pairs within n + e words, and the first of
   them lies at most 2e words behind the part's start. Every window that begins
   0 to 2e words before such a pair counts; windows that follow one another form a
   place, of which every (1 + e / 8)-th window is embedded. Items too short for the count are looked for around each of their words.
2. Repeated bit-sampling LSH: a CGK random walk (it copies a word, then moves on
   or stays by a random bit of the step, the word and the walk) maps edit distance
   to Hamming distance; a window and the item meet in a walk's bucket if the
   sampled steps agree. The number of walks for a length follows from the target
   recall and from the agreement of simulated pairs with all edits allowed.
3. The edit distance itself, between the item and any part of the place, by a
   bit-parallel recurrence: one step a word, whatever the item's length.

Walks are hashes, not tables, and windows are embedded in groups of equal length
and bounded size, so a very long item costs no more memory than its own length.
The benchmark is the small side: its rows and bytes are checked before it is
broadcast; a larger one is applied in chunks, one after the other.

Defined cases: null and empty texts contain nothing; items without words are
ignored; an item shorter than the window of a text may match the whole text;
repeated rows and items give repeated or merged results; empty tables give
empty results (an empty benchmark removes nothing); extra columns are kept,
whatever their names. Ids are integers.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, of_text, slices
from .ngram_join import mix

RATE = 0.15
#: Sampled steps of a bucket key, and the share of contained items, with all edits allowed, that the walks have to find.
BITS, RECALL = 2, 0.9999
#: Simulated pairs for the number of walks of a length.
TRIALS = 32
#: Walks that are taken at once (bits of a byte), and most bytes of a worker's table of their turns.
TOGETHER, TURNS_BYTES = 8, 64 << 20
#: Words of the windows that are embedded together.
CELLS = 1 << 20
#: Most rows and bytes of one chunk of the benchmark.
MAX_ITEMS, MAX_BYTES = 50_000, 64 << 20

_EDGES = re.compile(r"^\W+|\W+$")


def words_of(text: str) -> list[str]:
    """Lower-case words without punctuation at their edges."""
    return [w for x in text.lower().split() if (w := _EDGES.sub("", x))]


def masks_of(item: list[int]) -> dict[int, int]:
    """The places of every word of an item, as bits."""
    out: dict[int, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def masks_within(masks: dict[int, int], n: int, window: list[int], most: int) -> bool:
    """edit_within for the masks of an n-word item (Myers' bit vectors of Sellers' columns)."""
    if n <= most:
        return True
    full, top, distance = (1 << n) - 1, 1 << (n - 1), n
    up, down = full, 0  # where a column rises or falls by one
    for w in window:
        same = masks.get(w, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up) & full, up & across
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
            if distance <= most:
                return True
        rise, fall = rise << 1 & full, fall << 1 & full
        same |= down
        up, down = fall | ~(same | rise) & full, rise & same
    return False


def edit_within(item: list[int], window: list[int], most: int) -> bool:
    """Whether some contiguous part of window is within `most` word edits of item."""
    return masks_within(masks_of(item), len(item), window, most)


def walk(windows: np.ndarray, number: int, steps: np.ndarray) -> np.ndarray:
    """What CGK walk `number` copies at the given steps (sorted) from each row of word codes; -1 once a row is used up."""
    rows, n = windows.shape
    padded = np.concatenate([windows, np.full((rows, 1), -1, windows.dtype)], axis=1)
    line, at, out = np.arange(rows), np.zeros(rows, np.int64), np.empty((rows, len(steps)), np.int64)
    wanted = {int(x): i for i, x in enumerate(steps)}
    for step in range(int(steps[-1]) + 1):
        code = padded[line, at]
        if step in wanted:
            out[:, wanted[step]] = code
        with np.errstate(over="ignore"):
            bit = mix(code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step << 20 | number)) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), n)
    return out


@lru_cache(maxsize=1 << 16)
def steps_of(n: int, number: int) -> np.ndarray:
    """The steps that walk `number` samples for items of n words, in the part that walks of whole windows reach."""
    draws = np.random.default_rng([20240607, n, number]).permutation(2 * n)[: min(BITS, n)]
    return np.sort(draws)


def stride_of(edits: int) -> int:
    """Every so many starts of a place are embedded: a window that begins a little before a passage counts as a few edits more."""
    return 1 + edits // 8


@lru_cache(maxsize=4096)
def walks_for(n: int, edits: int, recall: float = RECALL) -> int:
    """Walks after which a window of a place with all edits allowed has met its item with the target recall: from the least agreement among simulated pairs, a tenth of them aside."""
    if not edits:
        return 1
    draw = np.random.default_rng([n, edits])
    items, windows = np.arange(TRIALS * n).reshape(TRIALS, n), np.empty((TRIALS, n), np.int64)
    for t in range(TRIALS):
        words = items[t].tolist()
        for _ in range(edits):
            at, how = int(draw.integers(len(words) + 1)), int(draw.integers(3))
            words[at : at + (how > 0)] = [] if how == 1 else [-5]
        windows[t] = ([-5] * int(draw.integers(stride_of(edits))) + words + [-5] * n)[:n]
    steps = np.unique(np.linspace(0, 2 * n - 1, 128).astype(np.int64))
    met = np.mean([(walk(items, r, steps) == walk(windows, r, steps)).mean(axis=1) for r in range(2)], axis=0)
    share = float(np.quantile(met, 0.1)) ** min(BITS, n)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(0.999, max(0.02, share)))))


def on_grid(n: int) -> int:
    """The next of the lengths, a tenth apart, for which walks are counted."""
    return n if n < 20 else int(round(20 * 1.1 ** math.ceil(math.log(n / 20, 1.1))))


def spans(at: np.ndarray, before: int, after: int) -> list[tuple[int, int]]:
    """The places from `before` words before to `after` words after each of the sorted positions, joined where they overlap."""
    cuts = np.flatnonzero(np.diff(at) > before + after) + 1
    first, last = at[np.concatenate([[0], cuts])], at[np.concatenate([cuts, [len(at)]]) - 1]
    return [(max(0, a - before), b + after) for a, b in zip(first.tolist(), last.tolist())]


@dataclass
class Index:
    """Word pairs, walks and bit masks of benchmark items, built once and broadcast."""

    rate: float
    recall: float = RECALL
    codes: dict[str, int] = field(default_factory=dict)
    items: list[tuple[int, list[int]]] = field(default_factory=list)
    #: What a worker finds out as it goes: words of texts, turns of walks, copies of items.
    known: dict[str, int] = field(default_factory=dict)
    turns: dict[tuple[int, range], np.ndarray] = field(default_factory=dict)
    copies: dict[tuple[int, range], np.ndarray] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple[int, str]], rate: float, recall: float = RECALL) -> Index:
        self = cls(rate, recall)
        for item_id, text in items:
            words = words_of(text or "")
            if words:
                self.items.append((item_id, [self.codes.setdefault(w, len(self.codes)) for w in words]))
        holders: dict[int, list[int]] = defaultdict(list)
        for i, (_, c) in enumerate(self.items):
            for pair in {x * len(self.codes) + y for x, y in zip(c, c[1:])}:
                holders[pair].append(i)
        self.pair_table = np.array(sorted(holders), np.int64)
        self.held = np.array([i for pair in self.pair_table.tolist() for i in holders[pair]], np.int64)
        self.held_n = np.array([len(holders[pair]) for pair in self.pair_table.tolist()], np.int64)
        self.held_at = np.cumsum(self.held_n) - self.held_n
        self.sizes = np.array([len(c) for _, c in self.items], np.int64)
        self.need = np.array([self.least(len(c)) for _, c in self.items], np.int64)
        self.tiny = [i for i, (_, c) in enumerate(self.items) if self.least(len(c)) == 0]
        self.masks = [masks_of(c) for _, c in self.items]
        of_size: dict[int, list[int]] = defaultdict(list)
        for i, size in enumerate(self.sizes.tolist()):
            of_size[size].append(i)
        self.of_size = dict(of_size)
        self.rank = np.zeros(len(self.items), np.int64)
        for numbers in of_size.values():
            self.rank[numbers] = np.arange(len(numbers))
        self.walks = {n: walks_for(on_grid(n), self.edits(on_grid(n)), recall) for n in set(self.sizes.tolist())}
        self.tabled = bool(self.walks) and (len(self.codes) + 2) * 2 * max(self.walks) * max(self.walks.values()) // TOGETHER <= TURNS_BYTES
        return self

    def _turns(self, step: int, numbers: range, code: np.ndarray) -> np.ndarray:
        """Whether each walk (a row of code) moves on from its word at a step; a used-up window stays."""
        seeds = (step << 20 | np.arange(numbers.start, numbers.stop, dtype=np.uint64))[:, None]
        with np.errstate(over="ignore"):
            if not self.tabled:
                return (mix(code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seeds) >> np.uint64(63)).astype(np.uint8) * (code >= 0)
            if (step, numbers) not in self.turns:  # a bit for each walk and word, the last one for the code -1
                every = mix(np.arange(len(self.codes) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seeds) >> np.uint64(63)
                every[:, -1] = 0
                self.turns[step, numbers] = np.packbits(every.astype(np.uint8), axis=0, bitorder="little")[0]
        return self.turns[step, numbers][code] >> np.arange(len(numbers), dtype=np.uint8)[:, None] & 1

    def copied(self, windows: np.ndarray, numbers: range) -> np.ndarray:
        """What several walks copy at their sampled steps from each row of word codes, as walk does one by one: walks, rows, steps."""
        rows, n = windows.shape
        flat = np.concatenate([windows, np.full((rows, 1), -1, windows.dtype)], axis=1).ravel()
        out, wanted = np.empty((len(numbers), rows, min(BITS, n)), np.int64), defaultdict(list)
        for w, number in enumerate(numbers):
            for i, step in enumerate(steps_of(n, number).tolist()):
                wanted[step].append((w, i))
        at = np.tile(np.arange(rows) * (n + 1), (len(numbers), 1))
        for step in range(max(wanted) + 1):
            code = flat[at]
            for w, i in wanted.get(step, ()):
                out[w, :, i] = code[w]
            at += self._turns(step, numbers, code)
        return out

    def _keys(self, n: int, numbers: range) -> np.ndarray:
        """What the walks copy from all items of n words, once per worker."""
        if (n, numbers) not in self.copies:
            self.copies[n, numbers] = self.copied(np.array([self.items[i][1] for i in self.of_size[n]], np.int64), numbers)
        return self.copies[n, numbers]

    def edits(self, n: int) -> int:
        return int(self.rate * n)

    def least(self, n: int) -> int:
        """Word pairs that a window within the edits of an n-word item shares with it."""
        return max(0, n - 1 - 2 * self.edits(n))

    def candidates(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(document, item, places) wherever enough word pairs of an item lie within its length and edits."""
        for i in self.tiny:
            words = np.array(self.items[i][1], np.int64)
            around = len(words) + self.edits(len(words))
            for d, codes in enumerate(docs):
                at = np.flatnonzero(np.isin(codes, words))
                if len(at):
                    yield d, i, spans(at, around, around)
        if not len(self.pair_table) or not docs:
            return
        flat = np.concatenate([x for codes in docs for x in (codes, np.array([-3]))])
        begins = np.cumsum([0] + [len(c) + 1 for c in docs])
        pair = flat[:-1] * len(self.codes) + flat[1:]
        pair[(flat[:-1] < 0) | (flat[1:] < 0)] = -1
        at = np.minimum(np.searchsorted(self.pair_table, pair), len(self.pair_table) - 1)
        places = np.flatnonzero(self.pair_table[at] == pair)
        row = at[places]
        n = self.held_n[row]
        items = self.held[np.repeat(self.held_at[row] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        places = np.repeat(places, n)
        owner = np.searchsorted(begins, places, side="right") - 1
        key = owner * len(self.items) + items
        order = np.lexsort((places, key))
        key, places = key[order], places[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([cuts, [len(key)]]))
        need = self.need[key[cuts] % len(self.items)]
        enough = (counts >= need) & (need > 0)
        for cut, count in zip(cuts[enough].tolist(), counts[enough].tolist()):
            d, i = divmod(int(key[cut]), len(self.items))
            p = places[cut : cut + count] - begins[d]
            e, size = self.edits(int(self.sizes[i])), int(self.sizes[i])
            inside = np.searchsorted(p, p + size - 1 + e, side="left") - np.arange(count)
            good = np.flatnonzero(inside >= self.need[i])
            if len(good):
                yield d, i, spans(p[good], 2 * e, size + e)

    def matches(self, docs: list[np.ndarray]) -> list[set[int]]:
        """Item numbers in every document of word codes (-1: no benchmark word)."""
        found: list[set[int]] = [set() for _ in docs]
        places: list[tuple[int, int, int, int]] = []
        of_size: dict[int, list[int]] = defaultdict(list)
        for d, i, spans_ in self.candidates(docs):
            for a, b in spans_:
                of_size[int(self.sizes[i])].append(len(places))
                places.append((d, i, a, b))
        for n, numbers in of_size.items():
            e = self.edits(n)
            every = stride_of(e)
            firsts = np.array([places[p][2] for p in numbers], np.int64)
            lasts = np.array([max(places[p][2], min(places[p][3] - n - e, len(docs[places[p][0]]) - 1)) for p in numbers], np.int64)
            counts = 1 + (lasts - firsts) // every
            owner = np.repeat(np.array(numbers, np.int64), counts)
            start = np.repeat(firsts, counts) + every * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
            step, verified = max(1, CELLS // n), set()
            for low in range(0, len(owner), step):
                self._meet(docs, n, places, owner[low : low + step], start[low : low + step], found, verified)
        return found

    def _meet(self, docs, n: int, places: list, owner: np.ndarray, start: np.ndarray, found: list[set[int]], verified: set[int]) -> None:
        """Some walks after the other: windows that share a bucket with their item have their place verified; each place is verified once."""
        left = np.array([p not in verified and places[p][1] not in found[places[p][0]] for p in owner.tolist()])
        owner, start = owner[left], start[left]
        windows = np.full((len(owner), n), -1, np.int64)
        for row, (p, a) in enumerate(zip(owner.tolist(), start.tolist())):
            piece = docs[places[p][0]][a : a + n]
            windows[row, : len(piece)] = np.where(piece < 0, len(self.codes), piece)  # words that no item has share one code
        item = np.array([places[p][1] for p in owner.tolist()], np.int64)
        for first in range(0, self.walks[n], TOGETHER):
            if not len(owner):
                return
            numbers = range(first, min(first + TOGETHER, self.walks[n]))
            met = (self.copied(windows, numbers) == self._keys(n, numbers)[:, self.rank[item]]).all(axis=2).any(axis=0)
            before = len(verified)
            for p in dict.fromkeys(owner[met].tolist()):
                d, i, a, b = places[p]
                verified.add(p)
                if i not in found[d] and masks_within(self.masks[i], n, docs[d][a:b].tolist(), self.edits(n)):
                    found[d].add(i)
            if len(verified) > before:
                left = np.array([p not in verified and places[p][1] not in found[places[p][0]] for p in owner.tolist()])
                windows, owner, item = windows[left], owner[left], item[left]


def _text_codes(texts: pa.Array, index: Index) -> list[np.ndarray]:
    """Word codes of every text of a batch; words of a batch are looked up once."""
    known = index.known
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.flatten().dictionary_encode()
    table = np.empty(len(coded.dictionary), np.int64)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        code = known.get(word)
        if code is None:
            bare = _EDGES.sub("", word.lower())
            code = index.codes.get(bare, -1) if bare else -2
            if len(known) < 300_000:
                known[word] = code
        table[i] = code
    codes = table[coded.indices.to_numpy(zero_copy_only=False)] if len(table) else np.zeros(0, np.int64)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    out = [codes[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)]
    return [c[c != -2] for c in out]


def _chunks(benchmark: DataFrame, item_col: str, text_col: str, max_items: int) -> Iterator[list[tuple[int, str]]]:
    """Items in chunks whose rows and bytes are bounded, one at a time."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    n = max(1, -(-size.n // max_items), -(-size.b // MAX_BYTES))
    for j in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == j)
        yield [(r.i, r.t) for r in part.collect()]  # checked to be small


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, max_items: int = MAX_ITEMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id of every benchmark item that a document contains."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for items in _chunks(benchmark, item_col, item_text_col, max_items):
        sent = spark.sparkContext.broadcast(Index.build(items, rate))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in slices(batches, rows=20_000, bytes_=32 << 20):
                ids, found = [], []
                for doc, items in zip(batch.column(0).to_pylist(), index.matches(_text_codes(batch.column(1), index))):
                    for i in sorted({index.items[m][0] for m in items}, key=lambda x: (x is None, x)):
                        ids.append(doc), found.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

        part = rows.mapInArrow(lean(run), "doc_id long, item_id long")
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, max_items: int = MAX_ITEMS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that contain no benchmark item, with their own columns."""
    spark = docs.sparkSession
    for items in _chunks(benchmark, item_col, item_text_col, max_items):
        sent = spark.sparkContext.broadcast(Index.build(items, rate))

        def judge(sent=sent):
            index = sent.value
            return lambda texts: pa.array([not x for x in index.matches(_text_codes(texts, index))], pa.bool_())

        docs = docs.where(of_text(judge, "boolean")(F.col(f"`{text_col}`")))
    return docs
