"""Spatial joins against all pairs, label records with boxes, masks and replay."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import boxes, noise, replay

BOX = "x double, y double, width double, height double"
CHARS = f"id string, element string, ord int, {BOX}, text string"
LINES = f"id string, element string, line int, {BOX}"


def random_page(rng, id_, element, chars, lines):
    """Coordinates on a coarse grid, so that borders and ties are frequent; some boxes are empty, some cover the page."""
    side = lambda: float(rng.choice([0, 0.5, 1, 2, 3, 8, 40, 300]))
    at = lambda: rng.randrange(-40, 80) / 2 * rng.choice([1, 1, 10])
    return [(id_, element, i, at(), at(), side(), side(), chr(97 + i % 26)) for i in range(chars)], [(id_, element, i, at(), at(), side(), side()) for i in range(lines)]


def brute(chars, lines):
    held, cut = {}, []
    for cid, ce, o, x, y, w, h, t in chars:
        for lid, le, line, lx, ly, lw, lh in lines:
            if (cid, ce) != (lid, le) or min(w, h, lw, lh) <= 0:
                continue
            if lx <= x + w / 2 <= lx + lw and ly <= y + h / 2 <= ly + lh:
                held.setdefault((cid, ce, o), (line, t))
            if x < lx + lw and x + w > lx and y < ly + lh and y + h > ly:
                cut.append((lid, le, line, x, y, x + w, y + h))
    return held, cut


@pytest.mark.parametrize("cell", [boxes.CELL, (2.0, 3.0), (10_000.0, 10_000.0)])
def test_joins_equal_all_pairs(spark, cell):
    rng, chars, lines = random.Random(5), [], []
    for id_, element in (("a", "0"), ("a", "1"), ("b", "title")):
        c, ln = random_page(rng, id_, element, 60, 40)
        chars, lines = chars + c, lines + ln
    lines.append(("c", "0", 0, 0.0, 0.0, 5.0, 5.0))
    held, cut = brute(chars, lines)
    c, ln = spark.createDataFrame(chars, CHARS), spark.createDataFrame(lines, LINES)
    got = boxes.chars_to_lines(c, ln, cell=cell).collect()
    assert {(r.id, r.element, r.ord): (r.line, r.text) for r in got} == held and len(got) == len(held)
    assert sorted(map(tuple, boxes.cut_boxes(c, ln, cell=cell).collect())) == sorted(cut)
    want = {}
    for id_, element, line, x, y, w, h in lines:
        if w > 0 and h > 0:
            own = [p for p in cut if p[:3] == (id_, element, line)]
            x0, y0 = (min(p[3] for p in own), min(p[4] for p in own)) if own else (x, y)
            text = "".join(t for _, t in sorted((k[2], v[1]) for k, v in held.items() if k[:2] == (id_, element) and v[0] == line))
            want[id_, element, line] = (x0, y0, (max(p[5] for p in own) if own else x + w) - x0, (max(p[6] for p in own) if own else y + h) - y0, text)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in boxes.line_records(c, ln, cell=cell).collect()}
    assert got == want
    assert {tuple(r)[:3]: tuple(r)[3:] for r in boxes.tight_lines(c, ln, cell=cell).collect()} == {k: v[:4] for k, v in want.items()}
    # the same boxes as arrays of one record; line numbers are places
    found = boxes.nested(c, ln).select("id", "element", F.explode(boxes.records_of(boxes.paired("chars", "lines"), cell)).alias("r")).select("id", "element", "r.*")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()} == want


def test_a_huge_paragraph_is_linear(spark):
    """200,000 characters and 10,000 lines of one element: two thousand million pairs, a few a character after the cells."""
    n = 200_000
    k = F.col("ord")
    chars = spark.range(n).select(F.lit("a").alias("id"), F.lit("0").alias("element"), F.col("id").cast("int").alias("ord")).select("id", "element", "ord", (k % 20 * 10.0).alias("x"), (F.floor(k / 20) * 10.0).alias("y"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"), F.lit("x").alias("text"))
    lines = spark.range(n // 20).select(F.lit("a").alias("id"), F.lit("0").alias("element"), F.col("id").cast("int").alias("line"), F.lit(0.0).alias("x"), (F.col("id") * 10.0).alias("y"), F.lit(200.0).alias("width"), F.lit(10.0).alias("height"))
    candidates = chars.select("id", "element", F.floor(F.col("x") / 256).alias("cx"), F.floor((F.col("y") + 5) / 32).alias("cy")).join(boxes._touched(lines, boxes.CELL), ["id", "element", "cx", "cy"])
    assert candidates.count() < 6 * n
    got = boxes.chars_to_lines(chars, lines)
    assert got.where("line = floor(ord / 20)").count() == got.count() == n


def test_joins_of_nothing_and_nulls(spark):
    c = spark.createDataFrame([("a", "0", 0, None, 1.0, 5.0, 5.0, "x"), ("a", "0", 1, 1.0, 1.0, None, 5.0, "y"), (None, "0", 1, 1.0, 1.0, 5.0, 5.0, "z")], CHARS)
    ln = spark.createDataFrame([("a", "0", 0, 0.0, 0.0, 50.0, 10.0), ("a", "0", 1, 0.0, None, 50.0, 10.0)], LINES)
    assert boxes.chars_to_lines(c, ln).count() == 0
    rows = {r.line: tuple(r)[3:] for r in boxes.line_records(c.limit(0), ln).collect()}
    assert rows[0] == (0.0, 0.0, 50.0, 10.0, "")
    assert boxes.line_records(c, ln.limit(0)).count() == 0 and boxes.caption_records(c, ln.limit(0)).count() == 0


def test_the_least_line_needs_no_shuffle_of_its_own(spark):
    c, ln = spark.createDataFrame([("a", "0", 0, 0.0, 0.0, 1.0, 1.0, "x")], CHARS), spark.createDataFrame([("a", "0", 0, 0.0, 0.0, 9.0, 9.0)], LINES)
    plan = boxes.chars_to_lines(c, ln)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "ShuffledHashJoin" in plan
    in_record = boxes.nested(c, ln).select("id", boxes.records_of(boxes.paired("chars", "lines")))._jdf.queryExecution().executedPlan().toString()
    assert in_record.count("Exchange") == 1  # that of nested


def test_caption_is_one_tight_line(spark):
    chars = spark.createDataFrame([("a", "0", i, 10.0 * (i % 2) + 2, 10.0 * (i // 2), 6.0, 8.0, t) for i, t in enumerate("abcd")], CHARS)
    lines = spark.createDataFrame([("a", "0", 0, 0.0, 0.0, 20.0, 9.0), ("a", "0", 1, 0.0, 9.0, 30.0, 11.0), ("a", "0", 2, 0.0, 9.0, 90.0, 0.0)], LINES)
    assert [tuple(r) for r in boxes.caption_records(chars, lines).collect()] == [("a", "0", 1, 2.0, 0.0, 16.0, 18.0, "abcd")]
    records = boxes.nested(chars, lines).unionByName(spark.createDataFrame([("b", "0", None, None), ("c", "0", [], [])], f"id string, element string, chars {boxes.CHARS}, lines {boxes.LINES}"))
    got = boxes.with_caption(records).select("id", "caption").collect()
    assert {r.id: r.caption and tuple(r.caption) for r in got} == {"a": (2.0, 0.0, 16.0, 18.0, "abcd"), "b": None, "c": None}


def test_records_of_odd_arrays(spark):
    """Null arrays, null boxes, null fields, null texts, no rows."""
    rows = spark.createDataFrame([(1, [(0.0, 0.0, 2.0, 2.0, None), None, (2.0, 0.0, 2.0, 2.0, "b"), (None, 0.0, 2.0, 2.0, "c"), (4.0, 0.0, float("nan"), 2.0, "d")], [None, (0.0, 0.0, 9.0, 2.0), (0.0, None, 9.0, 2.0)]), (2, None, [(0.0, 0.0, 9.0, 2.0)]), (3, [(0.0, 0.0, 2.0, 2.0, "é")], None)], f"id int, chars {boxes.CHARS}, lines {boxes.LINES}")
    got = {r.id: [tuple(x) for x in r.r] for r in rows.select("id", boxes.records_of(boxes.paired("chars", "lines")).alias("r")).collect()}
    assert got == {1: [(1, 0.0, 0.0, 4.0, 2.0, "b")], 2: [(0, 0.0, 0.0, 9.0, 2.0, "")], 3: []}
    assert rows.limit(0).select(boxes.records_of(boxes.paired("chars", "lines"))).count() == 0


def test_records_without_boxes_get_empty_arrays(spark):
    element = "type string, content string"
    labels = spark.createDataFrame([("a", [("text", "x"), ("image", None)]), ("b", []), ("c", None), (None, [("text", "y")])], f"id string, elements array<struct<{element.replace(' ', ':', 1).replace(', content ', ',content:')}>>")
    box = lambda x, w, t: (x, 0.0, w, 1.0, t)
    records = spark.createDataFrame([("a", "1", [box(0.0, 5.0, ""), box(0.0, 1.0, "cap")], [box(float(i), float(i % 2), str(i)) for i in range(4)]), ("a", "title", [box(1.0, 2.0, "T")], None), ("z", "0", [box(1.0, 2.0, "-")], [])], f"id string, element string, lines {boxes.BOXES}, chars {boxes.CHARS}")
    got = {r.id: r for r in boxes.with_boxes(labels, records).collect()}
    assert set(got) == {"a", "b", "c", None}
    assert [(b.text, b.width) for b in got["a"].elements[1].bboxes] == [("", 5.0), ("cap", 1.0)] and [b.text for b in got["a"].elements[1].char_bboxes] == ["1", "3"]
    assert got["a"].elements[0].bboxes == [] and got["a"].title_bboxes[0].text == "T" and got["a"].title_char_bboxes == []
    assert got["b"].elements == [] and got["b"].title_bboxes == [] and got[None].elements[0].char_bboxes == []


# --- masks and replay


def parts(spark):
    image = np.full((24, 32, 3), 128, np.uint8)
    ids = spark.createDataFrame([("1",), ("2",), ("2",), ("3",), (None,)], "id string")
    images = spark.createDataFrame([(i, 32, 24, bytearray(image.tobytes())) for i in ("1", "2", "9")], "id string, width int, height int, pixels binary")
    box = "struct<x:double,y:double,width:double,height:double,text:string>"
    elements = [("image", [(2.0, 3.0, 10.0, 5.0, ""), (2.0, 9.5, 10.0, 4.0, "cap")]), ("text", [(0.0, 0.0, 30.0, 20.0, "t")]), ("image", None)]
    metadata = spark.createDataFrame([(i, "#0f8", elements) for i in ("1", "3")], f"id string, figure_bg_color string, elements array<struct<type:string,bboxes:array<{box}>>>")
    log = images.select("id", noise.noise_config(F.col("id"), F.col("width"), F.col("height")).alias("config"))
    return ids, images, metadata, log


def test_replay_joins_where_tables_lie(spark):
    tables = [replay.bucketed(p, f"part{i}", buckets=4) for i, p in enumerate(parts(spark))]
    rows = replay.replay_rows(*tables)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.status for r in rows.collect()} == {"1": "ok", "2": "missing metadata", "3": "missing image,log"}


def test_masks_are_of_image_elements(spark):
    rows = replay.replay_rows(*parts(spark)).where("status = 'ok'")
    for target, want in (("img", [(2, 3, 12, 8, "")]), ("cap", [(2, 9, 12, 13, "cap")]), ("img_cap", [(2, 3, 12, 8, ""), (2, 9, 12, 13, "cap")])):
        assert [tuple(r) for r in rows.select(replay.mask_rects("elements", target).alias("r")).first().r] == want
    assert rows.select(replay.blue_green_red(F.col("figure_bg_color")).alias("c")).first().c == [136, 255, 0]


def test_replay_masks_first_and_adds_the_logged_noise(spark):
    rows = replay.replay_rows(*parts(spark))
    (got,) = replay.replay(rows, "cap").collect()
    row = rows.where("status = 'ok'").first().asDict(recursive=True)
    image = np.full((24, 32, 3), 128, np.uint8)
    image[9:14, 2:13] = (136, 255, 0)
    assert bytes(got.pixels) == noise.apply_noise(image, row["config"]).tobytes()
