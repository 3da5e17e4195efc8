"""Hand-made cases and properties."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import arrays, text
from folioforge.operators import batchapi, elements, layout, noise, ordering, sft
from folioforge.sources import readers, writers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_split_keeps_empty_parts(spark):
    r = one(spark, a=text.split_parts(F.lit(""), "\n\n"), b=text.split_parts(F.lit("a\n\n\nb"), "\n\n"), c=text.split_parts(F.lit("a\n\n"), "\n\n"))
    assert (r.a, r.b, r.c) == ([""], ["a", "\nb"], ["a", ""])


def test_kanji(spark):
    want = {0: "〇", 1: "一", 10: "十", 11: "十一", 20: "二十", 99: "九十九", 110: "百十", 305: "三百五", 1000: "千"}
    got = spark.createDataFrame([(k,) for k in want], "n int").select("n", text.to_kanji(F.col("n")).alias("k")).collect()
    assert {r.n: r.k for r in got} == want


def test_charset_and_suffix(spark):
    r = one(spark, a=text.rstrip_charset(F.lit("page_g.jpg"), ".jpg"), b=text.rstrip_charset(F.lit("pjpg.jpg"), ".jpg"), c=text.rstrip_charset(F.lit("x.png"), ".jpg"), d=text.remove_suffix(F.lit("page_g.jpg"), ".jpg"))
    assert (r.a, r.b, r.c, r.d) == ("page_", "", "x.pn", "page_g")


def test_vertical_digits(spark):
    r = one(spark, a=text.vertical_digits(F.lit("2024年12月５日")), b=text.vertical_digits(F.lit("a12月")))
    assert r.a == '2024年<span class="tcy">12</span>月<span class="tcy">5</span>日'
    assert r.b == "a12月"


def test_paths(spark):
    stem, extension = text.splitext(F.lit("a/b.c/d.JPG"))
    r = one(spark, base=text.basename(F.lit("a/b/c.png")), dir=text.dirname(F.lit("a/b/c.png")), stem=stem, ext=extension, mime=text.mime_of(F.lit("x.JPG")), url=text.data_url(F.lit(b"\1\2\3"), F.lit("image/png")))
    assert (r.base, r.dir, r.stem, r.ext, r.mime, r.url) == ("c.png", "a/b", "a/b.c/d", ".JPG", "image/jpeg", "data:image/png;base64,AQID")


def brute(images, texts, seed):
    """The least sum of squared distances, then of tie-breaks, over all choices, crossing ones too."""

    def cost(path):
        x = [(seed + i * 7919 + t * 104729) % 2147483647 for i, t in zip(images, path)]
        return sum((i - t) ** 2 for i, t in zip(images, path)), sum(v * v % 2147483647 for v in x)

    return list(min(itertools.permutations(texts, len(images)), key=cost))


def test_assignment_is_optimal_ordered_and_keyed():
    r = random.Random(1)
    assert elements.assign([], [1]) == [] and elements.assign([3], [7]) == [7]
    with pytest.raises(ValueError):
        elements.assign([1, 2], [0])
    for _ in range(300):
        n = r.randint(1, 8)
        places = sorted(r.sample(range(14), n))
        images = sorted(r.sample(places, r.randint(0, n // 2)))
        texts, seed = [p for p in places if p not in images], r.randrange(1 << 31)
        got = elements.assign(images, texts, seed)
        assert got == sorted(set(got)) and got == brute(images, texts, seed)
    sides = [elements.assign([3], [0, 2, 4], r.randrange(1 << 31))[0] for _ in range(200)]
    assert 60 < sides.count(2) < 140 and sides.count(2) + sides.count(4) == 200


def test_assignment_of_a_long_document_in_little_memory():
    """2,000 images by 40,000 texts: 80 million pairs; a matrix of them would take 1.3 GB."""
    import tracemalloc

    images = list(range(0, 42_000, 21))
    texts = [p for p in range(42_000) if p % 21]
    tracemalloc.start()
    got = elements.assign(images, texts, 5)
    assert tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()
    assert got == sorted(set(got)) and all(abs(i - t) == 1 for i, t in zip(images, got))


def test_native_fold_equals_program(spark):
    cases = [([1, 2], [0, 3, 4], 9), ([3], [0, 1, 2, 4], 8), ([3], [0, 1, 2, 4], 1 << 30), ([2, 3, 7], [0, 1, 4, 5, 6, 8], 12345)]
    rows = spark.createDataFrame(cases, "images array<int>, texts array<int>, seed long").select("images", "texts", "seed", elements.match_native(F.col("images"), F.col("texts"), F.col("seed")).alias("path"))
    for r in rows.collect():
        assert r.path == elements.assign(r.images, r.texts, r.seed)


def test_blocks(spark):
    flags = [0, 0, 1, 0, 1, 1, 0]
    rows = [(d, v, i, "image", bool(f)) for d, v in (("v", True), ("h", False)) for i, f in enumerate(flags)]
    got = layout.layout_blocks(spark.createDataFrame(rows, "id string, is_vertical boolean, pos int, type string, span_all boolean")).collect()
    assert [r.block for r in sorted(got, key=lambda r: r.pos) if r.id == "v"] == [0, 0, 1, 2, 3, 4, 5]
    assert {r.block for r in got if r.id == "h"} == {0}


def test_subsequences_and_masks(spark):
    ids = F.array(*map(F.lit, [9, 1, 2, 3, 1, 2, 3, 7]))
    r = one(spark, p=arrays.subsequence_positions(ids, [1, 2, 3]), m=arrays.mask_prefix(ids, ids, [1, 2, 3]), s=arrays.subsequence_positions(F.array(F.lit(1)), [1, 2]), n=arrays.mask_prefix(ids, ids, [8]), w=arrays.windows(F.array(F.lit(1), F.lit(2), F.lit(3)), 2))
    assert (r.p, r.m, r.s, r.n, r.w) == ([1, 4], [-100] * 4 + [1, 2, 3, 7], [], None, [[1, 2], [2, 3]])


def test_collate(spark):
    rows = spark.createDataFrame([(1, 0, [2, 2, 5, 6, 7]), (2, 0, [2, 2, 5, 6, 8, 9])], "id int, batch int, ids array<int>")
    got = {r.id: r for r in sft.collate(rows, [5, 6], [2], 0, bos=2).collect()}
    assert got[1].input_ids == [2, 5, 6, 7, 0] and got[1].labels == [-100, -100, -100, 7, -100] and got[1].attention_mask == [1, 1, 1, 1, 0]
    assert got[2].labels == [-100, -100, -100, 8, 9]


def test_quota_of_few_rows(spark):
    from folioforge.operators import dataset

    for n, want in ((3, {0: 3}), (1000, {0: 400, 1: 300, 2: 300})):
        rows = spark.range(n).select(F.format_string("%06d", F.col("id")).alias("id"))
        assert {r.noise_type: r["count"] for r in dataset.assign_noise(rows).groupBy("noise_type").count().collect()} == want


def test_noise_replays_and_masks(spark):
    image = np.full((24, 32, 3), 128, np.uint8)
    base = spark.createDataFrame([("000001", 32, 24, bytearray(image.tobytes()))], "id string, width int, height int, pixels binary")
    logged = base.withColumn("config", noise.noise_config(F.col("id"), F.col("width"), F.col("height")))
    first, again = (noise.noisy_images(logged).first().pixels for _ in range(2))
    assert first == again and len(first) == image.size and bytes(first) != image.tobytes()
    masked = noise.mask_rectangles(image, [{"x": 1.5, "y": 2.0, "width": 3.0, "height": 2.0}])
    assert (masked != image).any(axis=2).sum() == 4 * 3  # both ends of a rectangle are filled


def test_backend(spark):
    prompts = spark.createDataFrame([("a", "x\nlast\n"), ("b", None)], "key string, prompt string")
    assert {r.key: r.value for r in batchapi.generate(prompts).collect()} == {"a": "last", "b": ""}


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("000001", None, "x"), ("000002", "c", "y")], "id string, caption string, html string")
    writers.json_lines(rows, f"{tmp_path}/j")
    assert '"caption":null' in "".join(r.value for r in spark.read.text(f"{tmp_path}/j").collect())
    assert readers.json_lines(spark, f"{tmp_path}/j", "id string, caption string").count() == 2
    import pytest

    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        writers.json_lines(rows, f"{tmp_path}/j")
    writers.id_list(rows, f"{tmp_path}/ids")
    assert {r.id for r in readers.id_list(spark, f"{tmp_path}/ids").collect()} == {"000001", "000002"}
    writers.files(rows.withColumn("name", F.concat("id", F.lit(".txt"))), f"file://{tmp_path}/files", "name", "html")
    assert {r.value for r in readers.whole_texts(spark, f"{tmp_path}/files").collect()} == {"x", "y"}
    assert readers.listing(spark, f"{tmp_path}/files", "*.txt").count() == 2
    writers.dataset(rows.withColumn("split", F.lit("train")), f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d").where("split = 'train'").count() == 2
    writers.key_values(rows, f"{tmp_path}/kv", "id", "html")
    writers.pretty_json(rows, f"{tmp_path}/pretty", "id")
    assert spark.read.parquet(f"{tmp_path}/kv").count() == spark.read.parquet(f"{tmp_path}/pretty").count() == 2


def test_stream_resumes(spark, tmp_path):
    from folioforge.streaming.resume import process_new

    rows = spark.range(5).withColumn("x", F.lit("a"))
    rows.write.parquet(f"{tmp_path}/in/1")
    call = lambda: process_new(spark, f"{tmp_path}/in/*", "id bigint, x string", lambda d: d.select("id"), f"{tmp_path}/out", f"{tmp_path}/ck")
    call()
    spark.range(5, 8).withColumn("x", F.lit("b")).write.parquet(f"{tmp_path}/in/2")
    call()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(8))


def test_pages_have_blocks(spark):
    style = layout.with_style(spark.createDataFrame([("v", True, 2), ("h", False, 1), ("n", True, 1)], "id string, is_vertical boolean, column_count int"))
    element = "array<struct<type:string,content:string,src:string,caption:string,span_all:boolean>>"
    parts = [("text", "年12月", None, None, None), ("image", None, "s", "図3月", True), ("image", None, "t", None, True), ("text", None, None, None, None), ("image", None, "u", "", False)]
    docs = spark.createDataFrame([("v", "T", parts), ("h", "T", parts), ("n", None, None)], f"id string, title string, elements {element}")
    pages = layout.with_overrides(style.join(docs, "id"), show_title=F.lit(True), max_img_limit=F.lit(300))
    got = {r.id: r.html.partition("<body>\n")[2].partition("\n</body>")[0].split("\n") for r in layout.render_html(pages).collect()}
    figure = '<figure class="{}" data-id="{}"><img src="{}" class="content-image" style="{}300px">{}</figure>'.format
    assert got["v"] == [
        '<h1 data-id="title">T</h1>',
        '<div class="content-body"><p data-id="0">年<span class="tcy">12</span>月</p></div>',
        figure("span-all", 1, "s", "max-height:90%;max-width:", '<figcaption>図<span class="tcy">3</span>月</figcaption>'),
        figure("span-all", 2, "t", "max-height:90%;max-width:", ""),
        '<div class="content-body"><p data-id="3"></p>',
        figure("normal", 4, "u", "max-width:", "") + "</div>",
    ]
    assert got["h"][1:3] == ['<div class="content-body"><p data-id="0">年12月</p>', figure("span-all", 1, "s", "max-height:", "<figcaption>図3月</figcaption>")]
    assert got["h"][-1] == figure("normal", 4, "u", "max-height:", "") + "</div>" and got["n"] == ['<h1 data-id="title"></h1>', ""]


def test_names_and_keys(spark):
    r = one(spark, a=text.drop_last(F.lit("000123"), 3), b=text.drop_last(F.lit("ab"), 3), c=text.field(F.lit("nano_banana_7_001.png"), "_", 2), d=text.field(F.lit("x"), "_", 2))
    assert (r.a, r.b, r.c, r.d) == ("000", "", "7", None)
