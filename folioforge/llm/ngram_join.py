"""Operator 7, exact n-gram Jaccard join by universe partition.

A document's set is its distinct k-word shingles (64-bit hashes). Two sets of
sizes r <= s with Jaccard similarity of at least num/den differ in at most
H = (den - num)(r + s) / (den + num) elements. Sizes fall into bands; for each
band the hash universe is cut into m segments. A set of n elements is indexed
under the hashes of its subsets in the first K segments, K = H + 1 for the
largest partner that n allows, for its own band and for lower bands that can
hold partners. Linked sets have min(K) >= H + 1 segments in common and so agree
wholly in one of them (pigeonhole).

Allocation by cost: a key whose c sets would meet costs about c * c / 2 sketch
comparisons, refining it about 1 + n / m rows for each set. Segments of `LIGHT`
elements or fewer are met by chance, so they are refined at once; other keys
when more than `CROSS` * `hot` sets share them. The budget of a refined segment moves to
the next segment, which is matched up to one element: the key is joined with the
one-deletion neighbourhood of that segment. This loses no link: let z of the K'
common segments agree and be refined, and no other agree. If every follower of
those differs in two elements or more, the difference is at least
2z + (K' - 2z) = K' > H.

Candidates are never listed as pairs of a bucket. First, each set is verified
with the bucket hub that it shares most keys with; components of these links
settle most buckets. Then blocks of bounded size meet in buckets that still hold
several components: odd sketches (parity bitmaps, whose Hamming distance bounds
the symmetric difference from below) tell which sets may still link, and a
spanning forest of those pairs over the components is verified with the texts;
pairs that fail are left out of the next round. The last round verifies all pairs
that are left, so no link between components is lost. Each block has a set once:
a bucket of several blocks is dealt anew every round. If it stays open, its blocks
meet in pairs, or its key is refined where there are more than `CROSS` of them.
Exact copies collapse to one set beforehand, inside each task and over all.

Defined cases: null texts and texts without words have an empty set, link with
nothing and are their own component; a text of fewer than k words has one
shingle, the whole sequence; every row is judged by its text, so rows of one id
and different texts may be in different components, named by their least ids; rows
without an id take part, and a component of such rows alone has no id; an empty
table gives an empty result; other columns are not read by the join. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, save, slices
from .components import connected_components

#: Sets that may share a key before it is refined, and most sets of a block that meets in a task: 130,000 comparisons of sketches.
HOT = 512
#: Blocks of a bucket up to which all its pairs of blocks meet; a set goes to so many of them at most. Beyond, refining a key (some six rows for each, in three rounds) costs less.
CROSS = 8
#: Segments of up to this many elements are never keys alone.
LIGHT = 0
#: Most sets that one group verifies against its hub.
STAR_SETS = 250
#: Most places of a bitmap that tells which rows a join may want: 4 MB.
SIEVE = 1 << 25
#: Rounds of forests before all pairs that are left are verified.
ROUNDS = 2
#: Rows without an id are numbered from here by a hash of their text, behind all ids.
NO_ID = 1 << 62
_BAND = 1.25

_M1, _M2, _A = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The public SplitMix64 finaliser: a bijection of 64-bit words."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    # bytes.lower() changes A-Z alone, whatever the locale
    texts = pa.array([(t or "").encode().lower().decode() for t in texts.to_pylist()], pa.large_string())
    for space in "\t\n\v\f\r":
        texts = pc.replace_substring(texts, space, " ")
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False) if len(coded.dictionary) else np.zeros(0, bool)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    if empty.any():  # runs of white space leave empty words
        real = ~empty[codes]
        codes, owner = codes[real], owner[real]
        counts = np.bincount(owner, minlength=len(counts))
    words = table[codes] if len(codes) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - k + 1)
        grams = words[:n].copy()
        for j in range(1, k):
            grams = mix(grams * _A + words[j : j + n])
        grams = mix(grams + _A)
        out = []
        for start, stop in zip((ends - counts).tolist(), ends.tolist()):
            if stop - start >= k:
                out.append(np.unique(grams[start : stop - k + 1]))
            elif stop > start:
                h = np.zeros(1, np.uint64)
                for w in words[start:stop]:
                    h = mix(h * _A + w)
                out.append(mix(h + np.uint64(stop - start)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_id(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(tokens ^ _A).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


class Bands:
    """Size bands with their numbers of segments for a threshold num/den."""

    def __init__(self, num: int, den: int, largest: int = 1 << 34):
        self.num, self.den = num, den
        lows, highs, low = [], [], 1
        while low <= largest:
            high = max(low, int(low * _BAND))
            lows.append(low), highs.append(high)
            low = high + 1
        self.highs = np.array(highs, np.int64)
        self.budget = (den - num) * (self.highs + self.highs * den // num) // (den + num)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """The bands under which a set of n elements is indexed: (band, its segments m, those K that the set uses)."""
        own = int(np.searchsorted(self.highs, n))
        least = -(-n * self.num // self.den)
        out = []
        for b in range(int(np.searchsorted(self.highs, least)), own + 1):
            if self.budget[b] > 0:
                pair = n + n * self.den // self.num if b == own else int(self.highs[b]) + n
                out.append((b, int(self.budget[b]) + 1, (self.den - self.num) * pair // (self.den + self.num) + 1))
        return out


def segments(tokens: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of every element, and the sum of element hashes of every segment."""
    with np.errstate(over="ignore"):
        where = (mix(tokens + _A) % np.uint64(m)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, where, mix(tokens ^ _M1))
    return where, sums


def segment_keys(sums: np.ndarray, band: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(sums * _A + mix(np.arange(len(sums), dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(40))))


def sketch(tokens: np.ndarray) -> bytes:
    """Odd sketch: parities of the elements in 2 to 4 times as many bits as there are elements."""
    bits = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens + _M2) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def index_keys(tokens: np.ndarray, band: int, m: int, used: int) -> np.ndarray:
    """Keys of a set under a band. Segments of at most `LIGHT` elements say too little to stand alone: they are refined at once."""
    where, sums = segments(tokens, m)
    own = segment_keys(sums, band)
    light = np.bincount(where, minlength=m) <= LIGHT
    light[used:] = False
    if m == 1 or not light.any():
        return own[:used]
    with np.errstate(over="ignore"):
        follower = np.roll(sums, -1)
        behind = light[where - 1]  # elements whose segment follows a light one; -1 is the last
        near = mix(own[where[behind] - 1] + mix(sums[where[behind]] - mix(tokens[behind] ^ _M1) + _M2))
        return np.concatenate([own[:used][~light[:used]], mix(own[light] + mix(follower[light] + _M2)), near])


def _classes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), *batch.columns[2:]], names=["doc_id", "n", "set", *batch.schema.names[2:]])

    return run


def _keys(k: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, rows=500):
            keys, owners = [], []
            for tokens in shingle_sets(batch.column(0), k):
                if not len(tokens) or (me := set_id(tokens)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(me)
                for band in bands.of(len(tokens)):
                    keys.append(np.unique(index_keys(tokens, *band)))
                    owners.append(np.full(len(keys[-1]), me, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "set"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, set, hub) of keys with two distinct sets or more; input sorted by key and set. Keeps three rows between batches."""
    key = hub = last = None
    opened = False
    for batch in batches:
        if not batch.num_rows:
            continue
        ks, ss = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        done = 0
        if key is not None:
            before = [(key, hub)] if last == hub else [(key, hub), (key, last)]
            ks = np.concatenate([[x for x, _ in before], ks]).astype(np.int64)
            ss = np.concatenate([[y for _, y in before], ss]).astype(np.int64)
            done = len(before) if opened else 0
        new_key = np.concatenate([[True], ks[1:] != ks[:-1]])
        fresh = new_key | np.concatenate([[True], ss[1:] != ss[:-1]])
        fresh[:done] = True
        ks, ss, new_key = ks[fresh], ss[fresh], new_key[fresh]
        starts = np.flatnonzero(new_key)
        sizes = np.diff(np.concatenate([starts, [len(ks)]]))
        hubs = np.repeat(ss[starts], sizes)
        emit = np.repeat(sizes > 1, sizes)
        emit[:done] = False
        key, hub, last, opened = int(ks[-1]), int(hubs[-1]), int(ss[-1]), bool(sizes[-1] > 1)
        if emit.any():
            yield pa.RecordBatch.from_arrays([pa.array(ks[emit]), pa.array(ss[emit]), pa.array(hubs[emit])], names=["key", "set", "hub"])


def _index(rows: DataFrame, name: str) -> DataFrame:
    """The shared keys of (key, set) rows: one shuffle by key."""
    return save(rows.repartition("key").sortWithinPartitions("key", "set").mapInArrow(lean(_shared), "key long, set long, hub long"), name)


def _sifted(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose column may be one of wanted's values, and few others: what is not asked for need not be dealt for the join that follows.

    The values are marked in a bitmap of 64 places each, of SIEVE at most, whose
    pieces are broadcast; a larger wanted only lets more rows pass.
    """
    places = min(SIEVE, 1 << max(15, (64 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(places)) + 1
    marked = wanted.select(F.bitmap_bucket_number(place).alias("_piece"), F.bitmap_bit_position(place).alias("_bit"))
    pieces = marked.repartition("_piece").groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    here = F.getbit(byte, (bit % 8).cast("int")) == 1
    return rows.join(F.broadcast(pieces), F.bitmap_bucket_number(place) == F.col("_piece")).where(here).select(*rows.columns)


def _candidates(k: int):
    """Texts of the wanted sets with their sizes, sketches and what else is told of them; texts travel instead of shingles, which don't compress."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches, rows=500):
            sets, wanted = shingle_sets(batch.column(0), k), batch.column(1).to_pylist()
            right = []
            for i, want in enumerate(wanted):
                if want not in done and set_id(sets[i]) == want:
                    right.append(i)
                    if len(done) < 200_000:
                        done.add(want)
            at = pa.array(right, pa.int64())
            made = [batch.column(1).take(at), pa.array([len(sets[i]) for i in right], pa.int64()), pa.array([sketch(sets[i]) for i in right], pa.binary()), batch.column(0).take(at)]
            yield pa.RecordBatch.from_arrays(made + [c.take(at) for c in batch.columns[2:]], names=["set", "n", "sketch", "text", *batch.schema.names[2:]])

    return run


def _star(k: int, num: int, den: int):
    """Sets with their hub, and whether the two link; columns group, hub, set, text, each group sorted so that the hub comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, center = None, None
        for batch in slices(batches, rows=500):
            a, b, same = [], [], []
            for g, hub, me, tokens in zip(*(batch.column(i).to_pylist() for i in range(3)), shingle_sets(batch.column(3), k)):
                if me == hub:
                    group, center = g, tokens
                elif g == group:
                    both = len(np.intersect1d(center, tokens, assume_unique=True))
                    a.append(me), b.append(hub), same.append(den * both >= num * (len(center) + len(tokens) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(same, pa.bool_())], names=["a", "b", "same"])

    return run


def _refine(k: int, bands: Bands):
    """Hot keys of a set, each joined with the one-deletion neighbourhood of the following segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=200):
            keys, owners = [], []
            for me, hot, tokens in zip(batch.column(0).to_pylist(), batch.column(1), shingle_sets(batch.column(2), k)):
                wanted = hot.values.to_numpy().view(np.uint64)
                known = []
                for band, m, used in bands.of(len(tokens)):
                    where, sums = segments(tokens, m)
                    own = segment_keys(sums, band)[:used]
                    known.append(own)
                    for i in np.flatnonzero(np.isin(own, wanted)):
                        j = (int(i) + 1) % m
                        with np.errstate(over="ignore"):
                            near = np.concatenate([sums[j : j + 1], sums[j] - mix(tokens[where == j] ^ _M1)])
                            keys.append(mix(own[i] + mix(near + _M2)))
                        owners.append(np.full(len(near), me, np.int64))
                refined = wanted[~np.isin(wanted, np.concatenate(known))] if known else wanted  # keys of light segments, refined before
                keys.append(refined)
                owners.append(np.full(len(refined), me, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "set"])

    return run


class _Groups:
    """Disjoint sets of components."""

    def __init__(self, parts):
        self.parent = {p: p for p in parts}
        self.left = len(self.parent)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[x] = y
        self.left -= 1
        return True


def possible(n: np.ndarray, sketches: list[bytes], num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each set but the last (in order of size) the later ones that it may link with, and their least differences; n sorted."""
    held: dict[int, np.ndarray] = {}  # folded to the width of the smaller set
    for i in range(len(n) - 1):
        stop = int(np.searchsorted(n, int(n[i]) * den // num, side="right"))
        if stop <= i + 1:
            continue
        width = len(sketches[i])
        if width not in held:
            held = {width: np.zeros((len(n), width // 8), np.uint64)}
            for j in range(i, len(n)):
                words = np.frombuffer(sketches[j], np.uint64)
                held[width][j] = np.bitwise_xor.reduce(words.reshape(-1, width // 8), axis=0)
        rows = held[width]
        least = np.bitwise_count(rows[i + 1 : stop] ^ rows[i]).sum(axis=1, dtype=np.int64)
        good = np.flatnonzero((den + num) * least <= (den - num) * (n[i + 1 : stop] + n[i]))
        if len(good):
            yield i, good + i + 1, least[good]


def forest(sets: list[int], parts: list[int], n: list[int], sketches: list[bytes], failed: list, sides: list[int] | None, num: int, den: int, whole: bool) -> list[tuple[int, int]]:
    """Pairs of a block to verify: a spanning forest over its components of pairs that may link, the likeliest first, or all such pairs (whole). Sides, if given: only pairs of both sides."""
    order = np.argsort(np.array(n, np.int64), kind="stable")
    size = np.array(n, np.int64)[order]
    part = np.array(parts, np.int64)[order]
    side = np.array(sides, np.int64)[order] if sides is not None else None
    bad = {(sets[i], x) for i in range(len(sets)) for x in (failed[i] or ())}
    found: list[tuple[int, int, int]] = []
    for i, others, least in possible(size, [sketches[j] for j in order], num, den):
        open_ = part[others] != part[i]
        if side is not None:
            open_ &= side[others] != side[i]
        for j, d in zip(others[open_].tolist(), least[open_].tolist()):
            a, b = sets[order[i]], sets[order[j]]
            if a != b and (a, b) not in bad and (b, a) not in bad:
                found.append((d, i, j))
    if not found:
        return []
    if not whole:
        found.sort()
        groups = _Groups(part.tolist())
        found = [f for f in found if groups.left > 1 and groups.join(int(part[f[1]]), int(part[f[2]]))]
    pairs = [(sets[order[i]], sets[order[j]]) for _, i, j in found]
    return [(max(p), min(p)) for p in pairs]


def _pairs(num: int, den: int, whole: bool, sided: bool):
    """(set, hub) pairs to verify with their bucket; columns bucket, side, set, part, n, sketch, failed, sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, out = None, [], []

        def close() -> None:
            if len(held) > 1:
                _, sides, *columns = zip(*held)
                out.extend((a, b, bucket) for a, b in forest(*columns, sides if sided else None, num, den, whole))
            held.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["set", "hub", "bucket"])
            out.clear()
            return got

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != bucket:
                    close()
                    bucket = row[0]
                held.append(row)
            yield flush()
        close()
        yield flush()

    return run


def _grouped(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (set, hub) with the hub's group g in which a set is met, and the number c of each hub's groups."""
    hubs = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR_SETS).cast("int").alias("c"))
    return pairs.join(hubs, "hub").select("set", "hub", F.pmod(F.xxhash64("set"), F.col("c")).cast("int").alias("g")), hubs


class _Join:
    """The join's state: texts and sketches of candidate sets, links found, pairs that failed, components."""

    def __init__(self, found: DataFrame, k: int, num: int, den: int, hot: int):
        self.found, self.k, self.num, self.den, self.hot = found, k, num, den, hot
        self.checked: DataFrame | None = None
        self.parts: DataFrame | None = None
        self.moved = False

    def verify_first(self) -> None:
        """Verify each set with its hub: what a set does in these groups was stored beside its text, so texts are dealt by group only."""
        group = lambda hub: F.xxhash64(hub, "g").alias("group")
        members = self.found.where("hub is not null").select(group("hub"), "hub", "set", "text")
        centers = self.found.where("leads > 0").select("set", "text", F.explode(F.sequence(F.lit(0), F.col("leads") - 1)).alias("g"))
        self._verify(members.union(centers.select(group("set"), F.col("set").alias("hub"), "set", "text")))

    def verify(self, pairs: DataFrame) -> bool:
        """Verify (set, hub) pairs with the texts; a hub of many sets is met in several groups. Whether components may have changed."""
        pairs, hubs = _grouped(pairs)
        centers = hubs.select("hub", F.col("hub").alias("set"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("g"))
        # stored first, as they are read twice: only texts that they ask for are dealt by set
        ends = save(pairs.select("hub", "set", "g").union(centers), "pair-ends")
        texts = _sifted(self.found.select("set", "text"), ends.select("set"), "set")
        return self._verify(ends.join(texts, "set").select(F.xxhash64("hub", "g").alias("group"), "hub", "set", "text"))

    def _verify(self, stars: DataFrame) -> bool:
        new = save(stars.repartition("group").sortWithinPartitions("group", F.col("set") != F.col("hub")).mapInArrow(lean(_star(self.k, self.num, self.den)), "a long, b long, same boolean"), "verified")
        self.checked = new if self.checked is None else self.checked.union(new)
        links = new.where("same").select("a", "b")
        if self.parts is not None:
            if links.isEmpty():
                return False
            links = links.union(self.parts.select("set", "part"))
        self.parts = save(connected_components(links).select(F.col("node").alias("set"), F.col("component").alias("part")), "parts")
        return True

    def still_open(self, index: DataFrame) -> DataFrame:
        """Rows (key, set, part, c) of the buckets of c sets that hold several components."""
        rows = index.select("key", "set").join(self.parts, "set", "left").select("key", "set", F.coalesce("part", "set").alias("part"))
        totals = rows.groupBy("key").agg(
            F.count("*").alias("c"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.col("set"), F.lit(7))).alias("xor")
        )
        # buckets of the same members are settled once
        one = totals.where("lo <> hi").groupBy("sum", "xor", "c").agg(F.min("key").alias("key")).select("key", "c")
        return save(rows.join(one, "key"), "open-buckets")

    def meet(self, rows: DataFrame, seed: int, whole: bool) -> DataFrame | None:
        """Verify what blocks of open buckets propose; the rows that may still propose, or none if there was nothing.

        A bucket of one block that proposes nothing is settled for good: no sets of
        different components in it can link, and components only grow.
        """
        block = F.xxhash64("key", F.pmod(F.xxhash64("set", F.lit(seed)), F.ceil(F.col("c") / self.hot)))
        pairs = self._propose(rows.select(block.alias("bucket"), F.lit(0).alias("side"), "set", "part"), whole, False)
        if pairs is None:
            return None
        alive = rows.where(F.col("c") <= self.hot).withColumn("bucket", block).join(pairs.select("bucket").distinct(), "bucket", "left_semi")
        return alive.select(*rows.columns).union(rows.where(F.col("c") > self.hot))

    def _propose(self, dealt: DataFrame, whole: bool, sided: bool) -> DataFrame | None:
        bad = self.checked.where("not same")
        bad = bad.select(F.col("a").alias("set"), F.col("b").alias("x")).union(bad.select("b", "a")).groupBy("set").agg(F.collect_set("x").alias("failed"))
        rows = dealt.join(self.found.select("set", "n", "sketch"), "set").join(bad, "set", "left").select("bucket", "side", "set", "part", "n", "sketch", "failed")
        pairs = save(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_pairs(self.num, self.den, whole, sided)), "set long, hub long, bucket long"), "proposed-pairs")
        self.moved = False
        if pairs.isEmpty():
            return None
        self.moved = self.verify(pairs.select("set", "hub").distinct())
        return pairs

    def settle(self, index: DataFrame) -> DataFrame:
        """Rounds over an index's open buckets; returns those of several blocks that stay open."""
        rows = self.still_open(index)
        for seed in range(ROUNDS):
            alive = self.meet(rows, seed, False)
            if alive is None:
                rows = rows.where(F.col("c") > self.hot)
                break
            rows = self.still_open(alive) if self.moved else save(alive, "open-buckets")
        small, large = rows.where(F.col("c") <= self.hot), rows.where(F.col("c") > self.hot)
        self.meet(small, 0, True)
        return self.still_open(large) if self.moved else large

    def cross(self, rows: DataFrame) -> None:
        """The exact end for large open buckets: every block of sets outside a bucket's largest component meets the whole bucket, in blocks."""
        if rows.isEmpty():
            return
        count = rows.groupBy("key", "part").agg(F.count("*").alias("k"))
        main = count.groupBy("key").agg(F.max_by("part", F.struct("k", -F.col("part"))).alias("main"), (F.sum("k") - F.max("k")).alias("few"))
        at = rows.join(main, "key").withColumn("blocks", F.ceil(F.col("few") / self.hot).cast("int"))
        mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
        others = F.pmod(F.xxhash64("set", F.lit(3)), F.ceil(F.col("c") / self.hot)).cast("int")
        left = at.where("part <> main").select("key", "set", "part", mine.alias("x"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / self.hot).cast("int") - 1)).alias("y"), F.lit(0).alias("side"))
        right = at.select("key", "set", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), others.alias("y"), F.lit(1).alias("side"))
        self._propose(left.union(right).select(F.xxhash64("key", "x", "y").alias("bucket"), "side", "set", "part"), True, True)


def _numbered_id(id_col: str, text_col: str):
    """A row's id; rows without one are numbered by their text."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(F.col(f"`{text_col}`")), 2))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_numbered_id(id_col, text_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def shingle_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    out = _components(_numbered(docs, id_col, text_col), k, num, den, hot)
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return out.select(known("doc_id"), "n_shingles", known("component_id"))


def _components(texts: DataFrame, k: int, num: int, den: int, hot: int = HOT) -> DataFrame:
    bands = Bands(num, den)
    more = [c for c in texts.columns if c == "mark"]
    classes = save(texts.mapInArrow(lean(_classes(k)), "doc_id long, n long, set long" + ", mark long" * len(more)), "sets")
    index = _index(texts.select("text").mapInArrow(lean(_keys(k, bands)), "key long, set long"), "segment-index")
    first = classes.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    # every set with the hub (least set of a bucket) that it shares most keys with
    shared = index.where("set <> hub").groupBy("set", "hub").agg(F.count("*").alias("keys"))
    nearest, hubs = _grouped(save(shared.groupBy("set").agg(F.max_by("hub", F.struct("keys", -F.col("hub"))).alias("hub")), "nearest-hubs"))
    roles = nearest.withColumn("leads", F.lit(0)).unionByName(hubs.select(F.col("hub").alias("set"), F.lit(None).cast("long").alias("hub"), F.lit(None).cast("int").alias("g"), F.col("c").alias("leads")))
    roles = roles.groupBy("set").agg(F.max("hub").alias("hub"), F.max("g").alias("g"), F.max("leads").alias("leads"))
    wanted = save(roles.join(first.select("set", F.col("doc_id").alias("_rep")), "set"), "wanted-sets")
    asked = _sifted(texts.select("doc_id", "text"), wanted.select(F.col("_rep").alias("doc_id")), "doc_id")
    found = save(asked.join(wanted, F.col("doc_id") == F.col("_rep")).select("text", "set", "hub", "g", "leads").mapInArrow(lean(_candidates(k)), "set long, n long, sketch binary, text string, hub long, g int, leads int"), "candidate-texts")

    state = _Join(found, k, num, den, hot)
    state.verify_first()
    large = state.settle(index.select("key", "set"))
    state.cross(large.where(F.col("c") <= CROSS * hot))
    huge = large.where(F.col("c") > CROSS * hot)
    if not huge.isEmpty():
        hot_sets = huge.groupBy("set").agg(F.collect_set("key").alias("hot"))
        refined = _index(hot_sets.join(found.select("set", "text"), "set").select("set", "hot", "text").mapInArrow(lean(_refine(k, bands)), "key long, set long"), "refined-index")
        state.cross(state.settle(refined.select("key", "set")))

    named = first.join(state.parts, "set", "left").select("set", "doc_id", F.coalesce("part", "set").alias("part"))
    least = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    of_set = save(named.join(least, "part").select("set", "part", "component_id"), "set-components")
    joined = classes.join(of_set, "set", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *more, *["part" for _ in more])


def near_duplicate_filter(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document (the least id) of each component, with its own columns.

    Rows that repeat an id and its text count once; rows without an id stay only
    where no row with an id is in their component, equal texts of them once; null
    and empty texts stay. Input columns may have any names.
    """
    # rows are told apart by their id and a hash of their text, since an id may have several texts
    mark = F.xxhash64(F.col(f"`{text_col}`"))
    texts = docs.select(_numbered_id(id_col, text_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text"), mark.alias("mark"))
    found = save(_components(texts, k, num, den).where(F.col("doc_id") == F.col("component_id")), "kept-rows")
    # of a component with several texts of its least id, one stays; components of one least id are told apart by part
    texts_of = found.where("n_shingles > 0").groupBy("part", "doc_id", "mark").agg(F.count("*").alias("times"))
    least = texts_of.groupBy("part").agg(F.min("mark").alias("mark"))
    kept = texts_of.join(least, ["part", "mark"], "left_semi").select("doc_id", "mark", "times").unionByName(found.where("n_shingles = 0").groupBy("doc_id", "mark").agg(F.count("*").alias("times")))
    ids = save(kept, "kept-ids")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _numbered_id(id_col, text_col).alias("at"), mark.alias("mark"))
    out = rows.join(ids.select(F.col("doc_id").alias("at"), "mark"), ["at", "mark"], "left_semi").select("row.*")
    return out if ids.where("times > 1").isEmpty() else out.dropDuplicates([id_col, text_col])
