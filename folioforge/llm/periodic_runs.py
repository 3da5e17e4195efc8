"""Periodic runs of words in texts, and texts with their repetitions collapsed.

A run is a maximal stretch of words with smallest period q, at least three
periods and at least 24 words long. Every run has a Lyndon root that is the
longest Lyndon word at its place under one of two opposite word orders, so a
stack scanned from right to left under both orders proposes all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, of_text, table

MIN_WORDS, MIN_POWER = 24, 3
RUNS = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
#: Words of the windows that tell where runs can be: a run repeats each window of 8 at its period, inside itself.
_WINDOW = 8


def _windows(values: np.ndarray) -> np.ndarray:
    """Rolling hashes of all windows of eight words, by doubling."""
    for k in (1, 2, 4):
        values = values[:-k] * _STEP + (values[k:] ^ (values[k:] >> np.uint64(29)))
    return values


def repetitive_segments(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words that hold every run whole; equal windows always have equal hashes, so none is lost.

    All windows of a run but none beside it have another occurrence in the run.
    Hence runs lie in stretches of windows that occur again in their own stretch.
    """
    n = len(hashes)
    if n < MIN_WORDS:
        return []
    bits = np.uint64(n.bit_length())
    low = np.uint64((1 << int(bits)) - 1)
    key = (_windows(hashes) & ~low) | np.arange(n - _WINDOW + 1, dtype=np.uint64)
    key.sort()
    again = np.flatnonzero((key[1:] ^ key[:-1]) <= low)
    first, second = (key[again] & low).astype(np.int64), (key[again + 1] & low).astype(np.int64)
    while len(first):
        marked = np.zeros(n + 2, bool)
        marked[first + 1] = marked[second + 1] = True
        edge = np.flatnonzero(marked[1:] != marked[:-1])
        begin, end = edge[::2], edge[1::2] + _WINDOW - 1
        inside = np.searchsorted(begin, first, "right") == np.searchsorted(begin, second, "right")
        if inside.all():
            return [(int(b), int(e)) for b, e in zip(begin, end) if e - b >= MIN_WORDS]
        first, second = first[inside], second[inside]
    return []


class _Stretch:
    """Words as exact numbers with prefix hashes; longest common extensions of places."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _STEP
        mixed ^= mixed >> np.uint64(31)
        self.power = np.multiply.accumulate(np.full(self.n + 1, 0xD6E8FEB86659FD93, np.uint64))
        self.power = np.concatenate([np.ones(1, np.uint64), self.power])
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mixed * self.power[: self.n])])

    def _same(self, i: int, j: int, length: int) -> int:
        """Words in common from i and j on, at most length, compared one by one."""
        at, step = 0, 64
        while at < length:
            step = min(step * 4, length - at)
            a, b = self.ids[i + at : i + at + step], self.ids[j + at : j + at + step]
            if not np.array_equal(a, b):
                return at + int(np.argmax(a != b))
            at += step
        return length

    def next_smaller(self, sign: int) -> list[int]:
        """For every place the next one whose suffix is smaller: the longest Lyndon word at i ends there.

        Suffixes are compared by their extension: a hash search finds its length, the words confirm it.
        A stretch confirmed at a distance is remembered, so that long periodic texts are compared once.
        """
        n, ids = self.n, (sign * self.ids).tolist()
        prefix, power, seen = self.prefix.tolist(), self.power.tolist(), {}

        def extension(i: int, j: int) -> int:
            most = n - j
            known = seen.get(j - i)
            if known and known[0] <= i <= known[1]:
                return known[1] - i
            length, near = 1, min(most, 8)
            while length < near and ids[i + length] == ids[j + length]:
                length += 1
            if length < near or length == most:
                return length
            if known and i < known[0] <= i + length:
                seen[j - i] = (i, known[1])
                return known[1] - i
            shift, of_i, of_j, above = power[j - i], prefix[i], prefix[j], most
            while length < above:
                mid = (length + above + 1) >> 1
                if ((prefix[i + mid] - of_i) * shift - prefix[j + mid] + of_j) & _MASK:
                    above = mid - 1
                else:
                    length = mid
            if known and i < known[0] <= i + length and self._same(i, j, known[0] - i) == known[0] - i:
                length = known[1] - i
            else:
                length = self._same(i, j, length)
            seen[j - i] = (i, i + length)
            return length

        after = [n] * n
        for i in range(n - 2, -1, -1):
            word, j = ids[i], i + 1
            while j < n:
                other = ids[j]
                if word == other:
                    length = extension(i, j)
                    if j + length == n or ids[i + length] > ids[j + length]:
                        break
                elif word > other:
                    break
                j = after[j]
            after[i] = j
        return after

    def _search(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """Extensions of many pairs of places by a binary search on prefix hashes; never too short."""
        shift, low, high = self.power[j - i], np.zeros(len(i), np.int64), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            a, b = (self.prefix[i + mid] - self.prefix[i], self.prefix[j + mid] - self.prefix[j]) if forward else (self.prefix[i] - self.prefix[i - mid], self.prefix[j] - self.prefix[j - mid])
            same = a * shift == b
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def runs(self) -> set[tuple[int, int, int]]:
        """(start, length, period) of all runs, each root extended to both sides."""
        if self.n < MIN_WORDS:
            return set()
        i = np.tile(np.arange(self.n), 2)
        j = np.concatenate([self.next_smaller(1), self.next_smaller(-1)])
        keep = (j < self.n) & (MIN_POWER * (j - i) <= self.n)
        i, j = i[keep], j[keep]
        # a run has 16 words or more besides its root, so one of the two sides has 8
        window = _windows((self.ids.astype(np.uint64) + np.uint64(1)) * _STEP)
        last = len(window) - 1
        right = (j <= last) & (window[np.minimum(i, last)] == window[np.minimum(j, last)])
        left = (i >= _WINDOW) & (window[np.maximum(i - _WINDOW, 0)] == window[np.clip(j - _WINDOW, 0, last)])
        i, j = i[right | left], j[right | left]
        ahead, back = self._search(i, j, self.n - j, True), self._search(i, j, i, False)
        start, period = i - back, j - i
        length = j + ahead - start
        keep = length >= np.maximum(MIN_WORDS, MIN_POWER * period)
        found, roots = set(), np.stack([start, length, period, i], 1)[keep]
        _, unique = np.unique(roots[:, :3], axis=0, return_index=True)
        for s, size, p, root in roots[unique].tolist():
            if not (np.array_equal(self.ids[s : s + size - p], self.ids[s + p : s + size]) and (s == 0 or self.ids[s - 1] != self.ids[s - 1 + p]) and (s + size == self.n or self.ids[s + size] != self.ids[s + size - p])):
                end = root + p + self._same(root, root + p, self.n - root - p)
                s = root
                while s and self.ids[s - 1] == self.ids[s - 1 + p]:
                    s -= 1
                size = end - s
            if size >= max(MIN_WORDS, MIN_POWER * p):
                found.add((s, size, p))
        return found


def runs_of_words(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start and period."""
    found: list[tuple[int, int, int]] = []
    for begin, end in repetitive_segments(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)) if len(words) >= MIN_WORDS else []:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words[begin:end]), np.int64, end - begin)
        found += [(begin + s, size, p) for s, size, p in _Stretch(ids).runs()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _find() -> object:
    def apply(texts: pa.Array) -> pa.Array:
        counts, lists, collapsed = [], [], []
        for text in texts:
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            runs = runs_of_words(words)
            counts.append(len(words))
            lists.append([{"start": s, "length": size, "period": p} for s, size, p in runs])
            if runs:
                kept = np.ones(len(words), bool)
                for s, size, p in runs:
                    kept[s + p : s + size] = False
                words = [words[k] for k in np.flatnonzero(kept)]
            collapsed.append(b" ".join(words))
        run = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(lists, pa.list_(run)), pa.array(collapsed, pa.binary()).view(pa.string())], ["n_words", "runs", "collapsed"])

    return apply


def with_runs(docs: DataFrame, text_col: str = "text", out: str = "periodic") -> DataFrame:
    """Adds a struct: n_words, runs (start, length, period, by start and period) and the collapsed text.

    Words are split at ASCII white space. A null or empty text has no words, no
    runs and an empty collapsed text. Rows are judged each on its own, so
    repeated rows get equal results; other columns are kept, one named like out
    is replaced. A text is searched whole, in one task; nothing is shuffled.
    """
    return docs.withColumn(out, of_text(_find, RUNS)(F.col(text_col)))


def made_periodic(text: Column, key: Column) -> Column:
    """The text of one in ten keys with its words repeated from a place on; both follow from the key's crc32. Null keys change nothing."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & text.rlike(WORD), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def run_digests(found: DataFrame, column: str = "periodic") -> dict[str, Column]:
    """Columns of a found struct: number of runs, the run of most periods, digests of runs and collapsed text."""
    runs = F.col(f"{column}.runs")
    # greater exact length / period first; ties by start, then period
    ranked = F.array_sort(runs, lambda a, b: F.coalesce(F.nullif(F.signum(b["length"] * a["period"] - a["length"] * b["period"]), F.lit(0.0)), F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)), F.signum(a["period"] - b["period"])).cast("int"))
    best = F.get(ranked, F.lit(0))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return {
        "n_runs": F.size(runs).cast("bigint"),
        "start": best["start"],
        "length": best["length"],
        "period": best["period"],
        "exponent_milli": F.floor(1000 * best["length"] / best["period"]),
        "runs_sha256": F.sha2(lines.cast("binary"), 256),
        "collapsed_sha256": F.sha2(F.col(f"{column}.collapsed").cast("binary"), 256),
    }


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    found = with_runs(docs)
    return found.select("doc_id", *[c.alias(name) for name, c in run_digests(found).items()])


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII text, as DuckDB computes it bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda s: ascii(s)::bigint)), lambda c, b: {bits}), 4294967295)"


#: All pairs of equal words at a distance, their stretches, and of stretches that coincide the one of least period.
ORACLE = rf"""
with base as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, {crc32_sql('doc_id::varchar')} as h from documents),
cut as (select *, len(w) as n, h // 10 as g from base), place as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from cut),
unit as (select *, 1 + (n - a) // (3 + g % 8) as p from place),
made as (select doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[1 + (case when i < a then i else a + (i - a) % p end)]) end as w from unit),
word as (select doc_id, n, unnest(w) as w, unnest(range(n)) as i from made),
pair as (select x.doc_id, x.i, y.i - x.i as q from word x join word y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and 3 * (y.i - x.i) <= x.n),
island as (select *, i - row_number() over (partition by doc_id, q order by i) as island from pair),
stretch as (select doc_id, q, min(i) as start, count(*) + q as length from island group by doc_id, q, island having count(*) + q >= greatest(24, 3 * q)),
run as (select doc_id, start, length, min(q) as period from stretch group by doc_id, start, length),
best as (select *, row_number() over (partition by doc_id order by length::double / period desc, start, period) as place from run),
digest as (select doc_id, count(*) as n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)) as runs_sha256 from run group by doc_id),
covered as (select doc_id, unnest(range(start + period, start + length)) as i from run),
kept as (select doc_id, string_agg(w, ' ' order by i) as collapsed from word anti join covered using (doc_id, i) group by doc_id)
select m.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, (1000 * length) // period as exponent_milli,
  coalesce(runs_sha256, sha256('')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from made m left join digest using (doc_id) left join (select * from best where place = 1) using (doc_id) left join kept using (doc_id)
"""
