"""Each operator against brute force, SQL or an exact round trip, and its edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of_duck, rows_of_spark
from pyspark.sql import functions as F

from folioforge.llm import components, decontam, license_wordings, licenses, ngram_join, packing, quality, queries, token_binary, token_counts, tokenizing, toxicity, url_filters, warc

ODD = [None, "", " ", "  a  b ", "a\n b", "é\t x", "▁a ▁ b", "</s> x <s>", "a   the  of  ", "\n", "　x y", "it's <|endoftext|> don't 12,3  \n\n x", "日本 語  x", "ab日 cd。 a×b", "The cat " * 300]


def frame(spark, texts, **more):
    columns = "".join(f", {k} {v}" for k, v in more.items())
    return spark.createDataFrame([(i, t, *[None] * len(more)) for i, t in enumerate(texts)], f"doc_id long, text string{columns}")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_oracle(spark, sf, duck, name):
    got, want = rows_of_spark(queries.QUERIES[name](spark, sf)), rows_of_duck(duck, queries.ORACLES[name])
    assert got == want


def test_quality_edges(spark):
    rows = spark.createDataFrame([(1, None, None, None, 5), (2, "a b c d a b c d\n\n x" + " w" * 60, "en", "a", 7), (2, " ".join(f"w{i}" for i in range(60)), "en", "a", 1)], "doc_id long, text string, lang string, source string, stats int")
    got = sorted(tuple(r) for r in quality.quality_report(rows).collect())
    assert got[0] == (1, 0, 0, 0, 0, 0, True, False)
    assert got[1] == (2, 60, 170, 0, 0, 0, False, True)
    assert got[2] == (2, 69, 69, 0, 0, 68, True, False)
    assert quality.quality_filter(rows).columns == rows.columns and quality.quality_filter(rows).count() == 1
    assert quality.quality_report(rows.limit(0)).count() == 0


def test_quality_fences_follow_the_group(spark):
    r = random.Random(4)
    rows = []
    for source, capitals, words in (("prose", 1, 120), ("notes", 1, 300)):
        for d in range(300):
            rows.append((len(rows), " ".join("W" * r.randint(0, capitals) + f"word{r.randrange(9999)}x{i}" for i in range(words + r.randrange(20))), "en", source))
    signs = " ".join(f"word{1000 + i}x{i}" + ("#" if i % 4 == 0 else "") for i in range(120))
    rows += [(9003, signs, "en", "prose"), (9004, signs, "en", "notes"), (9005, signs.replace("#", ""), "en", "notes")]
    kept = {x.doc_id: x.kept for x in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), pull=0).collect()}
    assert [kept[9003], kept[9004], kept[9005]] == [True, False, True]  # equal ratios, other verdicts
    assert sum(kept[i] for i in range(600)) >= 590


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_token_counts_equal_library(spark, head):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizing.tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(frame(spark, ODD, known="int"), limit=100, head=head).collect()}
    for i, t in enumerate(ODD):
        n = len(model.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 100)


def test_chunks_encode_like_the_library():
    encoder = tokenizing.ChunkEncoder(tokenizing.tokenizer_path("byte_bpe_50k.json"), most=50)
    r = random.Random(2)
    pool = ["a", "b ", " ", "\n", "\t", "'s", "12", "é", "日", "<|endoftext|>", "word", ",", "　", "\x85", "!?", "​", "ſ", "×"]
    texts = [t or "" for t in ODD] + ["".join(r.choices(pool, k=r.randint(0, 25))) for _ in range(400)]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for low in range(0, len(texts), 50):
        ids, counts = encoder.encode(pa.array(texts[low : low + 50]))
        assert ids.tolist() == sum(want[low : low + 50], []) and counts.tolist() == [len(w) for w in want[low : low + 50]]


def test_wavelet_file_answers():
    import io

    token_binary.BLOCK, before = 256, token_binary.BLOCK
    try:
        r = np.random.default_rng(1)
        for n, high in ((0, 1), (1, 1), (5000, 50257), (3000, 3), (700, 100_000)):
            ids = r.integers(0, high, n).astype(np.uint32)
            out = io.BytesIO()
            token_binary.write_shard(out, ids, [1], np.array([n]))
            out.seek(0)
            file = token_binary.TokenFile(out)
            assert file.read_all().tolist() == ids.tolist() and file.n == n
            for i in range(0, n, 97):
                symbol = int(ids[i])
                places = np.flatnonzero(ids == symbol)
                assert file.access(i) == symbol and file.count(symbol) == len(places) and file.rank(symbol, i) == (places < i).sum()
                k = int((places < i).sum())
                assert file.select(symbol, k) == i
            if n:
                assert list(file.occurrences(int(ids[0]))) == np.flatnonzero(ids == ids[0]).tolist()
                assert file.count(1 << 20) == 0
    finally:
        token_binary.BLOCK = before


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizing.tokenizer_path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_binary.read_tokens(token_binary.write_tokens(frame(spark, ODD).repartition(3))).collect()}
    at = 0
    for i, ids in enumerate(encoded(ODD)):
        assert got[i] == (at, len(ids), crc(ids))
        at += len(ids)
    assert token_binary.read_tokens(token_binary.write_tokens(frame(spark, []))).count() == 0


def test_common_chunks_outlive_a_full_table(monkeypatch):
    """Chunks that come in every batch are encoded once, also when rare ones fill the table again and again."""
    enc, made = tokenizing.ChunkEncoder(tokenizing.tokenizer_path("byte_bpe_50k.json"), most=100), Counter()
    encode = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda chunk: (made.update([chunk]), encode(chunk))[1])
    common = " ".join(f"word{i}, naïve" for i in range(20))
    for batch in range(12):
        texts = [common, "", f"{batch} " + " ".join(f"rare{batch}x{i}" for i in range(70)) + "  end ", common]
        ids, counts = enc.encode(pa.array(texts))
        assert ids.tolist() == [i for e in encoded(texts) for i in e[:-1]] and counts.tolist() == [len(e) - 1 for e in encoded(texts)]
        assert len(enc.rows) < 300
    assert max(made[" " + w] for w in common.split()) == 1


def test_words_and_marks_share_rows():
    """A word is encoded once, whatever punctuation and line ends follow it; the ids stay the library's."""
    enc = tokenizing.ChunkEncoder(tokenizing.tokenizer_path("byte_bpe_50k.json"))
    words, marks = [f"{a}{b}ſühn" for a in "aÉñ" for b in "abcdefghij"], ["", ",", ".", "###", "'", "|>", "!?", '"', "...", "&&&"]
    texts = [" ".join(w + m for w in words) for m in marks] + ["\n".join(words), " " + ".\n".join(words) + ".", " ### \"\n###\nword '\ns", "<|endoftext|>\nword<|endoftext|>", "don't 's\n\nword\n word \n", "×\na÷ ª"]
    for batch in (texts, texts[::-1], ["", "\n", " ", *texts]):
        ids, counts = enc.encode(pa.array(batch))
        assert ids.tolist() == [i for e in encoded(batch) for i in e[:-1]] and counts.tolist() == [len(e) - 1 for e in encoded(batch)]
    assert len(enc.rows) < 3 * len(words)  # with and without a space, marks and the odd chunks; not each word with each mark


def test_packing_is_whole_and_tight(spark):
    texts = [*ODD, "many words here " * 2000]
    rows = packing.pack(frame(spark, texts).repartition(3), capacity=64).collect()
    want, seen = encoded(texts), defaultdict(list)
    for r in rows:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and crc(part) == r.ids_crc32 and (r.length == 64 or r.piece == 0)
        seen[r.doc_id].append((r.start, r.length))
    for i, ids in enumerate(want):
        assert sum(n for _, n in seen[i]) == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(frame(spark, [])).count() == 0


def least_sequences(histogram, capacity):
    """The known L2 lower bound: volume alone ignores that two lengths over half never share a sequence."""
    best = -(-sum(k * v for k, v in histogram.items()) // capacity)
    for small in range(0, capacity // 2 + 1, 16):
        alone = sum(v for k, v in histogram.items() if k > capacity - small)
        large = {k: v for k, v in histogram.items() if capacity // 2 < k <= capacity - small}
        rest = sum(k * v for k, v in histogram.items() if small <= k <= capacity // 2)
        room = sum((capacity - k) * v for k, v in large.items())
        best = max(best, alone + sum(large.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def test_packing_near_the_bound():
    r = random.Random(4)
    for scale in (1, 50):
        histogram = {r.randint(1, 2048): r.randint(1, 40) * scale for _ in range(300)}
        solved = packing.solve(histogram)
        packed = Counter()
        for content, n in solved.packing:
            assert sum(k * v for k, v in content.items()) <= 2048
            for k, v in content.items():
                packed[k] += v * n
        assert packed == Counter(histogram)
        assert solved.bound <= solved.sequences <= least_sequences(histogram, 2048) * 1.02 + 2
    lengths = [min(2047, 20 + int(r.expovariate(1 / 350))) for _ in range(20_000)]  # as documents have them
    solved = packing.solve(Counter(lengths))
    assert solved.priced > 0.5 * solved.sequences and solved.sequences <= solved.bound * 1.002 + 1  # most are priced


def test_packing_equals_exact_optima():
    """Every packing of small histograms, by exhaustive search over the pieces."""
    r = random.Random(11)
    for _ in range(25):
        capacity = 20
        pieces = [r.randint(3, 20) for _ in range(r.randint(1, 8))]

        def least(rest, bins, best):
            if len(bins) >= best:
                return best
            if not rest:
                return len(bins)
            for i in range(len(bins)):
                if bins[i] + rest[0] <= capacity:
                    best = min(best, least(rest[1:], bins[:i] + [bins[i] + rest[0]] + bins[i + 1 :], best))
            return min(best, least(rest[1:], [*bins, rest[0]], best))

        optimum = least(sorted(pieces, reverse=True), [], len(pieces) + 1)
        solved = packing.solve(Counter(pieces), capacity)
        assert solved.bound <= optimum + 1e-9 and optimum <= solved.sequences <= optimum + 1


def test_multiplicative_weights_cover_and_bound():
    r = random.Random(7)
    lengths = np.array(sorted(r.sample(range(20, 2047), 200)))
    counts = np.array([r.randint(500, 4000) for _ in lengths])
    found, left, bound = packing.configurations(lengths, counts, 2048)
    used = np.zeros(len(lengths))
    for content, amount in found.items():
        assert sum(int(lengths[j]) * n for j, n in content) <= 2048
        for j, n in content:
            used[j] += n * amount
    assert np.allclose(used + left, counts) and (left >= -1e-6).all() and left.sum() <= 0.01 * counts.sum()
    assert (lengths * counts).sum() / 2048 - 1e-6 <= bound <= sum(found.values()) * 1.01 + 1  # every length is covered but for a hundredth


def components_brute(rows, k, num, den):
    sets, inverted = {}, defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in (t or "")))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        for g in sets[i]:
            inverted[g].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in inverted[g] if j > i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def edited(r, words, rate):
    out = words[:]
    for _ in range(r.randint(0, max(1, int(len(out) * rate)))):
        p, how = r.randrange(len(out)), r.random()
        if how < 0.4:
            out[p] = f"n{r.randrange(300)}"
        elif how < 0.7 and len(out) > 1:
            del out[p]
        else:
            out.insert(p, f"n{r.randrange(300)}")
    return out


@pytest.mark.parametrize("k,num,hot,light", [(3, 90, 2, 0), (3, 90, 48, 1), (5, 80, 4, 0), (5, 80, 512, 0)])
def test_join_equals_brute_force(spark, k, num, hot, light, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    monkeypatch.setattr(ngram_join, "STAR_SETS", 16)
    r = random.Random(5)
    rows = list(enumerate([None, "", "a", "A", "a b", " a  b\t", "  ", "À b c", "à b c"]))
    for _ in range(9):
        base = [f"w{r.randrange(300)}" for _ in range(r.choice([4, 9, 12, 15, 30, 80, 200]))]
        for _ in range(r.choice([3, 20, 50])):
            rows.append((len(rows), " ".join(edited(r, base, r.choice([0.01, 0.03, 0.06])))))
    passage = [f"p{i}" for i in range(40)]  # one passage in many texts of their own
    for _ in range(40):
        rows.append((len(rows), " ".join(passage + [f"w{r.randrange(300)}" for _ in range(r.choice([1, 3, 9, 60]))])))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, num, 100, hot=hot).collect()}
    assert got == components_brute(rows, k, num, 100)


@pytest.fixture
def tables_of_join(monkeypatch):
    """Rows that the join stores, by the name of the table."""
    rows, save = defaultdict(int), ngram_join.save

    def counted(df, name):
        out = save(df, name)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(ngram_join, "save", counted)
    return rows


def test_few_blocks_meet_in_pairs_without_refining(spark, tables_of_join):
    """200 near copies that do not link: a key of several blocks is not turned into several keys of each set."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 10 + i % 5] + [f"x{i}"] + base[11 + i % 5 : 40] + [f"y{i}"] + base[41:])) for i in range(200)]
    rows += [(200 + i, t.replace("w59", "last")) for i, t in rows[:40]]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=48).collect()}
    assert got == components_brute(rows, 3, 90, 100) and len(set(got.values())) > 100
    assert tables_of_join["open-buckets"] and not tables_of_join["refined-index"]


def test_sifted_keeps_what_is_wanted(spark):
    rows = spark.range(-3000, 3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    wanted = spark.createDataFrame([(i,) for i in range(-3000, 3000, 10)] + [(1 << 62,)], "doc_id long")
    kept = {r.doc_id for r in ngram_join._sifted(rows, wanted, "doc_id").collect()}
    assert kept >= set(range(-3000, 3000, 10)) and len(kept) < 600 + 300
    assert ngram_join._sifted(rows, wanted.limit(0), "doc_id").count() == 0


def test_texts_that_no_one_shares_keys_with_are_not_dealt(spark, monkeypatch):
    """Few texts have partners; the join by id gets little more than those."""
    asked, sifted = [], ngram_join._sifted

    def counted(rows, wanted, column):
        out = sifted(rows, wanted, column)
        asked.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_sifted", counted)
    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(40))) for i in range(900)]
    rows += [(900 + i, t + " end") for i, t in rows[:20]]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_brute(rows, 3, 90, 100)
    assert 40 <= asked[0] < 120


def test_sketches_rule_out_no_link():
    r = random.Random(8)
    for n in (1, 5, 17, 64, 400):
        base = np.array(r.sample(range(1 << 60), n), np.uint64)
        sets = [np.unique(np.concatenate([base[: n - j], np.array(r.sample(range(1 << 60), j), np.uint64)])) for j in (0, 0, 1, 2, n // 10, n // 5, n // 2) if j <= n]
        sets.sort(key=len)
        found = {(i, int(j)) for i, others, _ in ngram_join.possible(np.array([len(x) for x in sets]), [ngram_join.sketch(x) for x in sets], 80, 100) for j in others}
        for i, a in enumerate(sets):
            for j in range(i + 1, len(sets)):
                both = len(np.intersect1d(a, sets[j]))
                assert 100 * both < 80 * (len(a) + len(sets[j]) - both) or (i, j) in found


def test_near_duplicates_without_ids_and_with_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base, 1), (4, base + " x", 2), (None, "alone without an id here", 3), (None, "alone without an id here", 3), (None, None, 4), (9, base, 5), (9, base, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _keep int").withColumn("set", F.lit("s")).withColumn("at", F.lit(1)).withColumn("row", F.lit(2))
    kept = ngram_join.near_duplicate_filter(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r._keep) for r in kept.collect()) == [(0, 3), (0, 4), (4, 2)]
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.shingle_components(docs, 5, 80, 100).collect())
    assert found == [(0, 0), (0, 0), (0, 0), (0, 4), (4, 4), (9, 4), (9, 4)]


def test_near_duplicate_filter_keeps_one(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(3, base, 1), (1, base + " x", 2), (2, None, 3), (5, base, 4), (6, "other text of its own here", 5), (2, None, 3)], "doc_id long, text string, set int")
    kept = ngram_join.near_duplicate_filter(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6]
    assert ngram_join.near_duplicate_filter(rows.limit(0)).count() == 0


def test_broadcast_pieces_are_the_most_frequent_ones_and_bounded(spark):
    counts = [1] * 500 + [2] * 100 + [3] * 40 + [50] * 7 + [1000, 40_000]
    rows = spark.createDataFrame([(str(i), n) for i, n in enumerate(counts)], "piece string, n long")
    for head in (0, 1, 2, 5, 9, 10, 60, 149, 648, 649, 10_000):
        least = token_counts._least_frequency(rows, head)
        taken = sum(n >= least for n in counts)
        below = max((n for n in counts if n < least), default=None)
        assert taken <= head and (below is None or taken + counts.count(below) > head)
    assert token_counts._least_frequency(rows.limit(0), 10) == 1


def test_licenses_of_rows_with_one_id_and_path(spark):
    mit, apache = (licenses.wordings()[k][0] for k in ("MIT", "Apache-2.0"))
    rows = [("1", "a/x", mit, False), ("1", "a/x", apache, False), ("1", "a/x", apache, False), ("1", "a/x", "nothing", False)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "id string, path string, text string, is_license_file boolean")).collect()
    assert sorted((r.license or "", r.origin or "") for r in got) == [("", ""), ("Apache-2.0", "own"), ("Apache-2.0", "own"), ("MIT", "own")]


def test_near_duplicate_filter_goes_by_row(spark):
    """One id with several texts: an exact copy of another row goes, a text of its own stays, of two texts of the least id one stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (7, c), (7, c + " more"), (8, c), (9, None), (9, "")], "doc_id long, text string")
    kept = [tuple(r) for r in ngram_join.near_duplicate_filter(docs).collect()]
    assert sorted(kept, key=repr)[:2] == [(3, b), (5, a)] and len(kept) == 5
    assert {(9, None), (9, "")} <= set(kept) and len([t for i, t in kept if i == 7]) == 1
    found = sorted((r.doc_id, r.component_id) for r in ngram_join.shingle_components(docs, 5, 80, 100).collect())
    assert found == [(3, 3), (5, 3), (5, 5), (7, 7), (7, 7), (8, 7), (9, 9), (9, 9)]


@pytest.mark.parametrize("chunk,turns", [(250_000, 32), (7, 2), (1, 1)])
def test_components(spark, chunk, turns, monkeypatch):
    monkeypatch.setattr(components, "CHUNK", chunk)
    monkeypatch.setattr(components, "TURNS", turns)
    r = random.Random(6)
    one_sided = [*range(301, 340, 2), *reversed(range(300, 340, 2))]  # rises and falls: one local maximum at a time
    edges = list(zip(one_sided, one_sided[1:])) + [(499, i) for i in range(400, 499)] + [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100, i) for i in range(101, 160)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0
    named = components.connected_components(spark.createDataFrame([("é", "z"), ("z", "a"), ("𝔘", "\uffee"), ("z", None)], "a string, b string"))
    assert {(x.node, x.component) for x in named.collect()} == {("a", "a"), ("z", "a"), ("é", "a"), ("\uffee", "\uffee"), ("𝔘", "\uffee")}


def test_edit_verification_equals_brute_force():
    r = random.Random(7)

    def least(item, window):
        best = len(item)
        for a in range(len(window) + 1):
            for b in range(a, len(window) + 1):
                part = window[a:b]
                d = list(range(len(part) + 1))
                for i, c in enumerate(item, 1):
                    d, old = [i, *d[1:]], d
                    for j, w in enumerate(part, 1):
                        d[j] = min(old[j - 1] + (c != w), old[j] + 1, d[j - 1] + 1)
                best = min(best, d[-1])
        return best

    for _ in range(60):
        item, window = [r.randrange(3) for _ in range(r.randint(1, 5))], [r.randrange(3) for _ in range(r.randint(0, 7))]
        for most in range(4):
            assert decontam.edit_within(item, window, most) == (least(item, window) <= most)


def test_decontamination_finds_edited_passages(spark):
    r = random.Random(8)
    items = [(i, " ".join(f"b{r.randrange(900)}" for _ in range(r.randint(15, 59)))) for i in range(30)]
    docs, planted = [], {}
    for d in range(90):
        words = [f"d{r.randrange(500)}" for _ in range(120)]
        if d % 3:
            item = r.choice(items)
            part = edited(r, item[1].split(), 0.1) if d % 3 == 2 else [w.upper() + "," for w in item[1].split()]
            words[50:50] = part
            planted[d] = item[0]
        docs.append((d, " ".join(words), d))
    rows = spark.createDataFrame([*docs, (90, None, 1), (91, "", 2)], "doc_id long, text string, codes int")
    benchmark = spark.createDataFrame([*items, (99, None), (98, " ")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(rows, benchmark).collect()}
    assert len(found & set(planted.items())) >= 0.95 * len(planted) and not found - set(planted.items())
    kept = decontam.decontaminate(rows, benchmark, max_items=20)
    assert kept.columns == rows.columns
    clean = {r.doc_id for r in kept.collect()}
    assert {d for d in range(92) if d not in planted} <= clean and len(clean & set(planted)) <= 0.05 * len(planted)
    assert decontam.decontaminate(rows, benchmark.limit(0)).count() == 92 and decontam.contaminated(rows.limit(0), benchmark).count() == 0


def test_decontamination_misses_nothing_behind_stray_pairs(spark):
    r = random.Random(12)
    items, docs, planted = [], [], set()
    for i in range(150):
        n = r.choice([15, 20, 38, 59])
        e, words = int(0.15 * n), [f"i{i}w{j}" for j in range(n)]
        part, at = words[:], r.randrange(n - 1)
        if i % 2:  # e edits, at places of their own
            for p in sorted(r.sample(range(n), e), reverse=True):
                part[p : p + 1] = r.choice([[], ["x"], [part[p], "x"]])
        gap = r.randint(e, 2 * e) - 2  # words between the stray pair and the passage
        items.append((i, " ".join(words)))
        docs.append((i, " ".join([*"abcdefgh", *words[at : at + 2], *["y"] * max(0, gap), *part, *"klmnop"])))
        planted.add((i, i))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert found == planted  # recall 1


def test_decontamination_of_rotated_copies_and_very_long_items(spark):
    r = random.Random(21)
    item = [f"b{i}" for i in range(20)]
    rotated = item[10:] + item[:10]
    three = ["x", *item[1:9], *item[10:15], "y", *item[16:]]
    long = [f"l{r.randrange(4000)}" for _ in range(12_000)]
    near = [w if r.random() > 0.05 else "z" for w in long]
    texts = [rotated * 3 + item, rotated + item, rotated * 3 + three, rotated, ["a"] * 50 + near + ["b"] * 9, long[:9000], item[:16]]
    rows = frame(spark, [" ".join(t) for t in texts])
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long)), (1, " ".join(item))], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(rows, benchmark).collect()} == {(0, 1), (1, 1), (2, 1), (4, 2)}


def test_walks_reach_their_recall():
    r, misses = random.Random(5), 0
    items = [[r.randrange(900) for _ in range(r.randint(12, 60))] for _ in range(300)]
    index = decontam.Index.build([(i, " ".join(f"w{x}" for x in t)) for i, t in enumerate(items)], 0.15)
    for i, (_, codes) in enumerate(index.items):
        n, part = len(codes), codes[:]
        for _ in range(index.edits(n)):
            p = r.randrange(len(part) + 1)
            part[p : p + r.randint(0, 1)] = r.choice([[], [-1]])
        window = np.array((part + [-1] * n)[:n])
        window[window < 0] = len(index.codes)
        steps = [decontam.steps_of(n, k) for k in range(index.walks[n])]
        misses += not any((decontam.walk(window[None], k, x) == decontam.walk(np.array([codes]), k, x)).all() for k, x in enumerate(steps))
    assert misses <= 3


def test_decontamination_equals_brute_force(spark):
    r = random.Random(13)
    items = [[f"w{r.randrange(4)}" for _ in range(r.randint(1, 16))] for _ in range(40)]
    docs = [[f"w{r.randrange(5)}" for _ in range(r.randint(0, 40))] for _ in range(60)] + [edited(r, i, 0.15) for i in items]
    rows = frame(spark, [" ".join(d) for d in docs])
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    for rate in (0.15, 0.4):
        got = {(x.doc_id, x.item_id) for x in decontam.contaminated(rows, benchmark, rate=rate).collect()}
        code = lambda words: [int(w[1:]) if w[0] == "w" else 99 for w in words]

        def least(item, text):  # Sellers' recurrence
            row, best = list(range(len(item) + 1)), len(item)
            for w in text:
                new = [0]
                for j, c in enumerate(item, 1):
                    new.append(min(row[j - 1] + (c != w), row[j] + 1, new[j - 1] + 1))
                row, best = new, min(best, new[-1])
            return best

        assert got == {(d, i) for d, text in enumerate(docs) for i, item in enumerate(items) if least(code(item), code(text)) <= int(rate * len(item))}


RULES = queries.URL_RULES
PAGES = [
    (1, None, "a", "block"), (2, "no scheme", None, "allow"), (3, "HTTP://A.Example.NET/de/81?x#y", "b", "block"), (4, "http://example.com/en/7", "c", "allow"),
    (4, "http://h.org?x=://es/", '<link rel="canonical" href="http://www.org/es/1">', "block"), (5, "http://free.test/1", "<LINK HREF='http://h.org?x=://es/' rel=canonical>", "block"),
    (6, "http://free.test/1/#a", "", "block"), (7, "http://other.test/", '<meta http-equiv="refresh" content="0; url=/1">', "allow"), (7, "http://www.org/es/1", "b", "block"), (8, "http://other.test/1?utm_a=3", "b", "allow"),
]


@pytest.mark.parametrize("literal", [0, 500])
def test_url_classes(spark, literal, monkeypatch):
    monkeypatch.setattr(url_filters, "MAX_LITERAL_RULES", literal)
    rows = spark.createDataFrame([(*p[:3], "h") for p in PAGES], "page_id long, url string, html string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filters.judge_urls(rows, RULES).collect())
    assert [(g[0], g[4]) for g in got] == [(1, "allow"), (2, "allow"), (3, "block"), (4, "allow"), (4, "block"), (5, "block"), (6, "block"), (7, "allow"), (7, "block"), (8, "allow")]
    assert (3, "a.example.net", "/de/81", "example.net/de/8", "block") in got and (1, "", "", "", "allow") in got
    assert url_filters.judge_urls(rows.limit(0), RULES).count() == 0


LINKS = [  # a page that links, its mark-up, the blocked address it means
    ("http://r.test/a/b/c", '<meta http-equiv="refresh" content="0; url=page.html">', "http://r.test/a/b/page.html"), ("http://r.test/a/b/d", "<link rel=canonical href='../x/./y'>", "http://r.test/a/x/y"),
    ("http://r.test/a/e?p=2", '<link rel="canonical" href="?p=1">', "http://r.test/a/e?p=1"), ("http://r.test", '<link rel="canonical" href="home">', "http://r.test/home"), ("http://r.test/f", '<link rel="canonical" href="../../top/../g">', "http://r.test/g"),
    ("http://r.test/h", '<link rel="canonical" href="http://r.test/q?a=1&amp;b=2">', "http://r.test/q?a=1&b=2"), ("http://r.test/i", '<link rel="canonical" href="/q?c=1&#38;d=&#x41;&#233;">', "http://r.test/q?c=1&d=Aé"), ("http://r.test/j", '<link rel="canonical" href="/out?u=http://free.test/z">', "http://r.test/out?u=http://free.test/z"),
    ("http://r.test/k/l", '<base href="/m/n/"><link rel="canonical" href="o">', "http://r.test/m/n/o"), ("http://r.test/p", '<BASE target=_top href="http://s.test/t/u"><link rel="canonical" href="v">', "http://s.test/t/v"), ("http://r.test/w", '<link rel="canonical" href="/q?e=&amp;lt;">', "http://r.test/q?e=&lt;"),
    ("http://r.test/free", '<link rel="canonical" href="mailto:a@r.test">', None), ("http://r.test/self", '<link rel="canonical" href="#top">', None),
]


def test_relative_and_encoded_targets(spark):
    rules = [("block", meant.partition("//")[2].partition("?")[0]) for _, _, meant in LINKS if meant]
    rows = [(i, url, html) for i, (url, html, _) in enumerate(LINKS)] + [(100 + i, meant, "") for i, (_, _, meant) in enumerate(LINKS) if meant and "?p=1" not in meant]
    rows.append((300, "http://blocked.test/1", '<link rel="canonical" href="http://r.test/a/e?p=1">'))
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), [*[r for r in rules if r[1] != "r.test/a/e"], ("block", "blocked.test/")]).collect()}
    assert [got[i] for i in range(len(LINKS))] == ["block" if meant else "allow" for _, _, meant in LINKS]


def test_allow_precedes_block_in_a_class(spark):
    edges = spark.createDataFrame([("http://x.com/en/1", "http://mid.test/"), ("http://mid.test/", "http://example.com/en/7")], "from_url string, to_url string")
    rows = spark.createDataFrame([(1, "http://mid.test"), (2, "http://x.com/en/1")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filters.judge_urls(rows, RULES, edges, html_col=None).collect()} == {1: "allow", 2: "block"}


def test_tracking_parameters_end_at_their_names(spark):
    rows = spark.createDataFrame([(1, "http://h.test/a?xref=1"), (2, "http://h.test/a?xref=2"), (3, "http://h.test/a?utm_q=1&ref=5"), (4, "http://h.test/a")], "page_id long, url string")
    got = rows.select("page_id", url_filters.address(F.col("url")).alias("a")).collect()
    assert {r.page_id: r.a for r in got} == {1: "h.test/a?xref=1", 2: "h.test/a?xref=2", 3: "h.test/a", 4: "h.test/a"}


def test_url_classes_equal_brute_force(spark):
    """Random redirects between pages and URLs that no page has: chains, hubs, equal rules, allow before block."""
    r = random.Random(14)
    hosts = ["example.com/en/7", "a.com/en/", "b.net/de/", "example.net/de/8", "c.org/es/", "d.test/", "e.test/x/", "f.test/y/"]
    urls = [f"http://{r.choice(hosts)}{i}" for i in range(160)]
    pages = [(i, u) for i, u in enumerate(urls[:90])] + [(200, urls[0]), (201, None)]
    edges = [(r.choice(urls), r.choice(urls)) for _ in range(70)] + [(urls[5], u) for u in urls[100:112]] + [(None, urls[3])]

    def rule(url):
        host, _, path = url[7:].partition("/")
        fits = [(-len(x), v != "allow", v) for v, x in RULES if (host == x.partition("/")[0] or host.endswith("." + x.partition("/")[0])) and ("/" + path).startswith("/" + x.partition("/")[2])]
        return min(fits)[2] if fits else None

    parent = {u: u for u in urls}

    def root(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for a, b in edges:
        if a and b:
            parent[root(a)] = root(b)
    said = defaultdict(set)
    for u in {u for i, u in pages if u} | {u for e in edges for u in e if u}:
        said[root(u)].add(rule(u))
    want = {i: "allow" if not u else rule(u) or ("block" if "block" in said[root(u)] and "allow" not in said[root(u)] else "allow") for i, u in pages}
    got = url_filters.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), RULES, spark.createDataFrame(edges, "from_url string, to_url string"), html_col=None)
    assert {x.page_id: x.verdict for x in got.collect()} == want and len(set(want.values())) == 2


def test_license_inheritance(spark):
    rows = spark.createDataFrame(
        [(1, "a/LICENSE", "Released under the MIT License.", True), (2, "a/b/x", "print", False), (3, "a/b/c/LICENSE", "# Licensed under the Apache License, Version 2.0", True), (4, "a/b/c/d/y", None, None),
         (5, None, "SPDX gpl", False), (6, "z", "", False), (7, "a/b/c/d/k", "// Licensed under CC BY-NC 4.0.\ncode", False)],
        "id long, path string, text string, is_license_file boolean",
    )
    got = {r.id: (r.license, r.origin) for r in licenses.scan_licenses(rows).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: ("Apache-2.0", "inherited"), 5: (None, None), 6: (None, None), 7: ("CC-BY-NC-4.0", "own")}
    assert licenses.scan_licenses(rows.limit(0)).count() == 0


LICENSE_HEADERS = [
    ("MIT", "// SPDX-License-Identifier: MIT\nint x;"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"),
    ("GPL-3.0", "# Copyright (C) 2011 A. Writer\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nimport os\n"),
    ("GPL-2.0", " * This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later version.\n */\n\n\nmain() {}"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================\n"), ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989"),
    ("MIT", "This source code is licensed under the MIT license, see LICENSE file in the project root."), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"), ("CC-BY-NC-SA-4.0", "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("MIT", "Copyright 2021 The X Authors\n\n" + " ".join(license_wordings.whole_texts()["MIT"].split()) + "\n\ncode"), ("BSD-3-Clause", "Copyright (c) 2001, B\n" + license_wordings.whole_texts()["BSD-3-Clause"]), ("BSD-2-Clause", "Copyright (c) 2001, B\n" + license_wordings.whole_texts()["BSD-2-Clause"]),
    (None, "Copyright (c) 2020 John Doe"), (None, "See the LICENSE file for details."), (None, "A driving licence is required of everyone. " * 40), (None, "SPDX-License-Identifier: Zlib"),
]


def test_license_headers(spark):
    rows = spark.createDataFrame([(i, f"{i}/x", t, False) for i, (_, t) in enumerate(LICENSE_HEADERS)], "id long, path string, text string, is_license_file boolean")
    got = {r.id: r.license for r in licenses.scan_licenses(rows).collect()}
    assert [got[i] for i in range(len(LICENSE_HEADERS))] == [want for want, _ in LICENSE_HEADERS]


def test_license_texts_of_any_length_pass_on(spark):
    texts = license_wordings.whole_texts()
    prose = "The committee of the town met in the old hall and spoke of a licence for the market. " * 9 + " ".join(f"word{i} of the" for i in range(99))
    rows = [(i, "Copyright (c) 1999, Someone Else\n\n" + t, "en", name) for i, (name, t) in enumerate(sorted(texts.items()))]
    rows += [(100 + i, "nothing", "en", name) for i, name in enumerate(sorted(texts))] + [(200, prose, "en", "town"), (201, prose + "\nReleased under the MIT License.", "en", "town"), (202, "nothing", "en", "town"), (203, None, "en", "town")]
    assert all(len(t) >= 400 for t in texts.values())
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan_licenses(licenses.documents_as_files(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), id_col="doc_id").collect()}
    assert all(got[i] == (name, "own") and got[100 + i] == (name, "inherited") for i, name in enumerate(sorted(texts)))
    assert [got[i] for i in range(200, 204)] == [(None, None), ("MIT", "own"), (None, None), (None, None)]


def test_archives_round_trip_and_repeat(spark):
    rows = spark.createDataFrame([(1, "http://a b\n", "x"), (2, None, None), (3, "u", ""), (4, "v", "é" * 999), (5, "w", "x"), (5, "z", "x"), (6, "t", "own")], "page_id long, url string, html string")
    one, two = (warc.write_archives(rows.repartition(n), file_bytes=600) for n in (1, 3))
    assert sorted(r.sha1 for r in one.collect()) == sorted(r.sha1 for r in two.collect())
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.read_archives(one).collect())
    assert got == [(1, 1, "revisit", 5), (2, 0, "revisit", 3), (3, 0, "response", 0), (4, 1998, "response", 0), (5, 1, "response", 0), (5, 1, "revisit", 5), (6, 3, "response", 0)]
    assert warc.read_archives(warc.write_archives(rows.limit(0))).count() == 0


def test_toxicity_learns_and_leaves_clean_alone(spark):
    r = random.Random(9)
    texts, labels = [], []
    for d in range(500):
        words = ["".join(r.choices("bcdfgaeiou", k=5)) for _ in range(60)]
        toxic = d % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(60), "krux" + r.choice(["el", "an", "or"]))
        texts.append(" ".join(words))
        labels.append((d, int(toxic), 1))
    docs, marks = frame(spark, [*texts, None, ""], lang="string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {x.doc_id: x for x in toxicity.toxicity_scores(docs, marks).collect()}
    held = [d for d in range(500) if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d].held_out for d in held) and all(0 <= x.score <= 1 for x in got.values())
    right = sum(got[d].predicted == labels[d][1] for d in held)
    assert right >= 0.97 * len(held) and got[500].predicted == got[501].predicted == 0
    kept = toxicity.toxicity_filter(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 502 - sum(x.predicted for x in got.values())
    assert toxicity.toxicity_scores(docs.limit(0), marks.limit(0)).count() == 0


def test_grammar_contexts():
    m = toxicity.Model()
    assert m.matches("you are an idiot")[0][1] == "targeted" and m.matches("an idiot")[0][1] == "plain"
    assert m.matches("you are not an idiot")[0][1] == "negated" and m.matches("she said you are an idiot")[0][1] == "reported"
    assert [c for _, c in m.matches("i will kill you; they never kill you. he said i kill him")] == ["threat", "negated threat", "reported threat"]
    assert not m.matches("kill the process") and not m.matches("kill the whole process, you") and m.matches("kill\nyou") == []
    assert m.score("you are an idiot") > m.score("she said you are an idiot") > m.score("")


def interpreted(model, text):
    """The grammar read word by word, clause by clause, by its description: no tables, no transducers."""
    out = []
    for clause in re.split(r"[.!?;:,\n()\"«»“”]+", text.lower()):
        words, best = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause), None
        kinds = [model.kinds.get(w) or ("I" if model.weight(w) else "O") for w in words]
        threat = None  # the last verb that still waits for a target
        for i, kind in enumerate(kinds):
            negated, reported = "N" in kinds[max(0, i - 3) : i], "R" in kinds[:i]
            match = None
            if kind == "I":
                match = model.weight(words[i]), "negated" if negated else "reported" if reported else "targeted" if "T" in kinds[max(0, i - 4) : i] else "plain"
            elif kind == "K":
                threat = i, "negated threat" if negated else "reported threat" if reported else "threat"
            elif kind == "T" and threat and i - threat[0] <= 3:
                match, threat = (toxicity.THREAT, threat[1]), None
            if match and (value := match[0] * model.factors[match[1]]) > (best[0] if best else 0):
                best = value, match[1]
        out += [best] if best else []
    return out


def test_grammar_equals_interpreter():
    r, m = random.Random(3), toxicity.Model()
    words = ["idiot", "scum", "kill", "hurt", "you", "them", "not", "never", "said", "a", "b", "c", "d."]
    texts = [" ".join(r.choices(words, k=r.randint(0, 40))) + r.choice(["", ",", "\n you idiot"]) for _ in range(1500)] + ["idiot " * 5000]
    scanner = toxicity.Scanner(m, most=40)
    owner, values, contexts, _ = scanner.matches(pa.array([*texts, None, ""]))
    found = defaultdict(list)
    for o, v, c in zip(owner, values, contexts):
        found[int(o)].append((float(v), toxicity.CONTEXTS[c]))
    for i, text in enumerate(texts):
        want = interpreted(m, text)
        assert found[i] == m.matches(text) and [c for _, c in found[i]] == [c for _, c in want] and np.allclose([v for v, _ in found[i]], [v for v, _ in want])
    scores = scanner.scores(pa.array([*texts, None, ""]))
    assert all(abs(x - m.score(t or "")) < 1e-12 for x, t in zip(scores, [*texts, None, ""]))


def test_context_weights_are_learned(spark):
    """Insults that are denied or told of are clean here, threats toxic; the weights of their contexts move accordingly."""
    r = random.Random(2)
    rows, labels = [], []
    for d in range(900):
        words = " ".join("".join(r.choices("bcdfgaeiou", k=6)) for _ in range(20))
        part, toxic = r.choice([("you idiot", 1), ("he is not an idiot", 0), ("she said scum", 0), ("i kill you", 1), ("", 0)])
        rows.append((d, f"{words}. {part}. {words}"))
        labels.append((d, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert model.factors["negated"] < 0.15 and model.factors["reported"] < 0.25 and model.factors["threat"] > 1.2 > model.factors["negated"] * 5
    got = {x.doc_id: x.predicted for x in toxicity.toxicity_scores(docs.union(docs.limit(5)), marks).collect()}
    assert np.mean([got[d] == t for d, t in labels if zlib.crc32(str(d).encode()) % 3 == 1]) >= 0.97


def test_every_clause_adds_its_weight():
    m = toxicity.Model(prior=-6.0)
    for n in (1, 8, 9, 20):
        text = "she said he is not an idiot. " * n
        z = m.prior + sum(w for w, _ in m.matches(text))
        assert len(m.matches(text)) == n and abs(m.score(text) - 1 / (1 + np.exp(-z))) < 1e-12


def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    from folioforge.llm.common import save, table

    docs = table(spark, sf, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, sf), name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= ids
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(i == c for i, (_, c) in components_brute(rows, 5, 80, 100).items())
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == ids and sum(r.length for r in packed) == sum(map(len, encoded([r.text for r in docs.collect()])))
