"""Periodic runs, source mixing and rolling windows against brute force and in edge cases."""

import bisect
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from folioforge.llm import curriculum, periodic_runs, rolling


# --- periodic runs


def brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, size, q) for (s, size), q in out.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    words, k = [], rng.choice([1, 2, 3, 5, 50])
    for _ in range(rng.randint(0, 6)):
        unit = [b"%d" % rng.randrange(k) for _ in range(rng.randint(1, 12))]
        words += (unit * rng.randint(1, 9))[: rng.randint(0, 80)] if rng.random() < 0.6 else [b"%d" % rng.randrange(k) for _ in range(rng.randint(0, 30))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        words = random_words(rng)
        assert periodic_runs.runs_of_words(words) == brute_runs(words), words


def test_runs_survive_colliding_hashes(monkeypatch):
    """With hashes that say nothing, words decide: every run found is a run of brute force."""
    monkeypatch.setattr(periodic_runs, "_STEP", periodic_runs.np.uint64(0))
    rng = random.Random(12)
    for _ in range(200):
        words = random_words(rng)
        assert set(periodic_runs.runs_of_words(words)) <= set(brute_runs(words))


def test_long_texts_take_little_time():
    """A million equal words, a long period, a word of many runs and words without any."""
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 20_000:
        a, b = b, b + a
    assert periodic_runs.runs_of_words([b"x"] * 300_000) == [(0, 300_000, 1)]
    unit = [b"%d" % i for i in range(1000)]
    assert periodic_runs.runs_of_words(unit * 200) == [(0, 200_000, 1000)]
    assert len(periodic_runs.runs_of_words(b)) > 1000
    assert periodic_runs.runs_of_words([b"%d" % i for i in range(1_000_000)]) == []


def test_runs_of_edge_rows(spark):
    long = "a b c " * 40_000
    rows = [(1, None, "p", "c"), (2, "", None, "c"), (3, " \n ", "p", None), (4, "x　y " * 30, "p", "c"), (4, "x　y " * 30, "p", "c"), (None, "a\tb\n" * 12, "p", "c"), (6, long, "p", "c"), (7, "a b " * 11 + "a", "p", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, periodic string, collapsed string")
    got = periodic_runs.with_runs(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    found = [(r.doc_id, r.periodic.n_words, [tuple(x) for x in r.periodic.runs], r.periodic.collapsed, r.collapsed) for r in got.collect()]
    same = (4, 30, [(0, 30, 1)], "x　y", "c")
    assert sorted(found, key=repr) == sorted([(1, 0, [], "", "c"), (2, 0, [], "", "c"), (3, 0, [], "", None), same, same, (None, 24, [(0, 24, 2)], "a b", "c"), (6, 120_000, [(0, 120_000, 3)], "a b c", "c"), (7, 23, [], "a b " * 11 + "a", "c")], key=repr)
    assert periodic_runs.with_runs(docs.limit(0)).count() == 0


def test_run_digests(spark):
    words = [b"a", b"b"] * 15 + [b"c"] * 30 + [b"d"] * 30
    docs = spark.createDataFrame([(1, b" ".join(words).decode()), (2, None)], "doc_id long, text string")
    found = periodic_runs.with_runs(docs)
    one, none = found.select("doc_id", *[c.alias(k) for k, c in periodic_runs.run_digests(found).items()]).orderBy("doc_id").collect()
    # both single-word runs have 30 periods; the first one wins
    assert (one.n_runs, one.start, one.length, one.period, one.exponent_milli) == (3, 30, 30, 1, 30_000)
    assert one.runs_sha256 == hashlib.sha256(b"0,30,2\n30,30,1\n60,30,1\n").hexdigest()
    assert one.collapsed_sha256 == hashlib.sha256(b"a b c d").hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(none) == (2, 0, None, None, None, None, empty, empty)


def test_made_periodic(spark):
    text = " ".join(f"w{i}" for i in range(57))
    rows = [(i, text) for i in range(400)] + [(None, text), (10, None), (10, "")]
    got = {(r.doc_id, r.text): r.made for r in spark.createDataFrame(rows, "doc_id long, text string").withColumn("made", periodic_runs.made_periodic(F.col("text"), F.col("doc_id"))).collect()}
    words, n = text.split(), 57
    for i in range(400):
        h = zlib.crc32(str(i).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert got[i, text] == (" ".join(w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)) if h % 10 == 0 else text)
    assert got[None, text] == text and got[10, None] is None and got[10, ""] == ""


# --- source mixing

FLAT = [(0, 1), (1, 1)]


def documents(spark, sizes, source="s"):
    return spark.createDataFrame([(i, "w " * n, source) for i, n in enumerate(sizes)], "doc_id long, text string, source string")


def fill(sizes, weights, cap=3):
    """Water filling, one source after the other."""
    total, full = sum(sizes.values()), set()
    while True:
        rest, over = total - sum(cap * sizes[s] for s in full), sum(w for s, w in weights.items() if s not in full)
        more = {s for s in sizes if s not in full and rest * weights[s] / over > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else rest * weights[s] / over for s in sizes}
        full |= more


def test_targets_equal_water_filling(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i:02}": rng.choice([0, 1, 5, 100, 10_000, rng.randrange(1, 5000)]) for i in range(n)}
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in curriculum.source_targets(table, curriculum.SCHEDULES).collect()}
        assert got == pytest.approx(fill(sizes, weights)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_meets_targets_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = curriculum.plan(docs, curriculum.SCHEDULES).collect()
    again = curriculum.plan(docs.repartition(7), curriculum.SCHEDULES).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again)) and len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(taken) - target) <= 0.5 for (_, target), taken in by.items())
    times = [r.time for r in rows if r.time is not None]
    assert times == sorted(times) and all((r.time is None) == (r.taken == 0) for r in rows)


def test_positions_follow_the_schedules(spark):
    """Between any two times, a source gives the words of its integral, but for a document at each end."""
    schedules = {"a": [(0, 3), (0.5, 0), (1, 1)], "b": [(0, 0), (1, 2)]}
    docs = documents(spark, [7] * 1500, "a").unionByName(documents(spark, [11] * 1500, "b").withColumn("doc_id", F.col("doc_id") + 10_000))
    planned = curriculum.plan(docs, schedules)
    rows, given_out = planned.collect(), curriculum.pieces(planned, schedules).collect()
    exact = {"a": lambda t: (3 * t - 3 * t * t if t <= 0.5 else 0.75 + (t - 0.5) ** 2) / 1.0, "b": lambda t: t * t}
    for source in "ab":
        target = next(r.target for r in rows if r.source == source)
        for t in (0.1, 0.25, 0.5, 0.6, 0.9):
            given = sum(r.words for r in given_out if r.source == source and r.time < t)
            assert abs(given - target * exact[source](t)) < 40, (source, t)
    placed = sorted((r.time, r.position) for r in rows if r.time is not None)
    assert [p for _, p in placed] == sorted(p for _, p in placed)


def test_time_of_share_inverts_share_at(spark):
    for schedule in (*curriculum.SCHEDULES, [(0, 0), (0.2, 0), (0.7, 4), (1, 0)]):
        rows = spark.range(101).select((F.col("id") / 100).alias("s")).withColumn("t", curriculum.time_of_share(F.col("s"), schedule)).withColumn("back", curriculum.share_at(F.col("t"), schedule)).collect()
        assert all(abs(r.back - r.s) < 1e-9 and 0 <= r.t <= 1 for r in rows) and [r.t for r in rows] == sorted(r.t for r in rows)
    with pytest.raises(ValueError):
        curriculum.weight([(0, 1), (0.5, 1)])


def test_mix_of_edge_rows(spark):
    rows = [(1, None, "a", 9), (2, "", "a", 9), (3, "x y z", None, 9), (3, "x y z", None, 9), (None, "x y", "b", 9), (5, "w " * 20_000, "b", 9), (6, "u", "é", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    got = curriculum.plan(docs, [FLAT]).collect()
    assert len(got) == 7 and sorted(r.size for r in got) == [0, 0, 1, 2, 3, 3, 20_000]
    want = fill({"a": 0, "b": 20_002, "é": 1, None: 6}, dict.fromkeys(["a", "b", "é", None], 1))
    assert {r.source: r.target for r in got} == pytest.approx(want) and all(r.taken <= 3 * r.size for r in got)
    for source, target in want.items():
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 0.5
    assert curriculum.plan(docs.limit(0), [FLAT]).count() == 0
    assert curriculum.plan(docs.where("text is null"), [FLAT]).collect()[0].taken == 0


def test_training_stream(spark):
    docs = documents(spark, [5, 8, 3, 9], "a").unionByName(documents(spark, [400], "b").withColumn("doc_id", F.lit(9).cast("long")))
    stream = curriculum.training_stream(docs, {"a": [(0, 1), (1, 1)], "b": [(0, 3), (1, 3)]}).collect()
    assert [r.time for r in stream] == sorted(r.time for r in stream)
    assert all(len(r.text.split()) == r.words for r in stream)
    assert sum(r.words for r in stream if r.source == "a") == 75 and {r["pass"] for r in stream if r.source == "a"} == {0, 1, 2}
    assert sum(r.words for r in stream if r.source == "b") == 350


# --- rolling windows


def test_skip_list_equals_a_sorted_list():
    rng, skip, plain = random.Random(2), rolling.SkipList(), []
    for step in range(20_000):
        if plain and rng.random() < (0.3 if step < 10_000 else 0.6):
            value = rng.choice(plain)
            plain.remove(value)
            skip.remove(value)
        else:
            value = rng.randrange(300)
            bisect.insort(plain, value)
            skip.insert(value)
        assert skip.size == len(plain)
        if plain:
            rank = rng.randint(1, len(plain))
            assert skip.at(rank) == plain[rank - 1]


def test_windows_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(0, 300, 10)]), rng.choice([None, 0, 3, 3, 7, rng.randrange(50)]), rng.choice([None, "x", "y", "z"])) for i in range(600)]
    rows += rows[:20] + [(1000 + i, "a", -5 - i, i, "x") for i in range(30)]
    events = spark.createDataFrame(rows, "k long, g string, t long, v long, c string").repartition(5)
    got = rolling.rolling_features(events, [15, 40, 100], [(1, 2), (99, 100), (1, 1)], F.col("k"), F.col("g"), F.col("t"), F.col("v"), F.col("c"))
    want = []
    for k, g, t, _, _ in rows:
        for w in (15, 40, 100):
            seen = [r for r in rows if t is not None and r[2] is not None and r[1] == g and t - w <= r[2] < t]
            values = sorted(r[3] for r in seen if r[3] is not None)
            ranks = [values[math.ceil(len(values) * n / d) - 1] if values else None for n, d in ((1, 2), (99, 100), (1, 1))]
            want.append((k, w, t, len(seen), sum(values), len({r[4] for r in seen} - {None}), *ranks))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_windows_of_edge_rows(spark):
    events = spark.createDataFrame([(None, "s", None, 5, "x"), (1, "s", 10, None, None), (1, "s", 10, None, None), (2, "s", 11, 1 << 40, "x"), (3, "s", 111, 1, "y")], "slice long, own string, time long, id long, kind string")
    got = rolling.rolling_features(events, [100], [(1, 2)], F.col("slice"), F.col("own"), F.col("time"), F.col("id"), F.col("kind"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, 100, None, 0, 0, 0, None), (1, 100, 10, 0, 0, 0, None), (1, 100, 10, 0, 0, 0, None), (2, 100, 11, 2, 0, 0, None), (3, 100, 111, 1, 1 << 40, 1, 1 << 40)], key=repr)
    assert rolling.rolling_features(events.limit(0), [100], [(1, 2)], F.col("slice"), F.col("own"), F.col("time"), F.col("id"), F.col("kind")).count() == 0


def test_event_time(spark):
    got = spark.range(500).select("id", rolling.event_time(F.col("id")).alias("t")).collect()
    assert all(r.t == 60 * ((r.id + zlib.crc32(str(r.id).encode()) % 1000) // 6) for r in got)
