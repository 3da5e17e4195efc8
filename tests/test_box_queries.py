"""Queries over boxes: what is shuffled and what crosses to Python."""

import numpy as np
import pyarrow as pa

from folioforge.operators import boxes
from folioforge.plans import catalogue, derived


def made(texts):
    return derived._arrays(pa.array(texts), pa.array(np.zeros(len(texts)))).flatten()


def test_lines_come_with_what_is_asked_for():
    chars, lines = made(["a word or two " * 30, "", "é" * 45])
    owner, both = boxes.lines_in(chars, lines)
    assert list(both) == ["line", "x", "y", "width", "height", "text"]
    only, texts = boxes.lines_in(chars, lines, box=False)
    assert list(texts) == ["line", "text"] and texts["text"] == both["text"] and (only == owner).all()
    _, tight = boxes.lines_in(chars, lines, text=False)
    assert list(tight) == ["line", "x", "y", "width", "height"] and all(tight[k] == both[k] for k in tight)


def test_char_to_line_makes_no_boxes(spark, sf):
    plan = catalogue.QUERIES["char_to_line"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "records" not in plan and "width" not in plan and "Generate explode(records" not in plan


def test_line_tight_box_makes_no_texts(spark, sf):
    plan = catalogue.QUERIES["line_tight_box"](spark, sf)._jdf.queryExecution().optimizedPlan()
    made_ = plan.toString().split("MapInArrow", 1)[1].splitlines()[0]
    assert "width" in made_ and "text" not in made_.split("]")[-2]


def test_char_boxes_leave_python_as_totals(spark, sf):
    plan = catalogue.QUERIES["char_boxes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "chars#" not in plan.split("+- Project")[0]
    chars, _ = made(["a b", " ", "", "é\u00a0x"])
    got = boxes.totals_in(chars)
    assert got["n_boxes"].to_pylist() == [2, 0, 0, 3] and got["text"].to_pylist() == ["ab", "", "", "é\u00a0x"]
    assert got["sum_x"].to_pylist() == [-1.0 + 21.0, 0.0, 0.0, -1.0 + 10.0 + 21.0] and got["sum_y"].to_pylist() == [0.0, 0.0, 0.0, -5.0]


def test_line_records_shuffle_nothing(spark, sf):
    assert "Exchange" not in catalogue.QUERIES["line_records"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_boxes_of_label_documents_are_not_shuffled(spark, sf):
    """Boxes are made above the last exchange, and leave as lists and digests."""
    plan = catalogue.QUERIES["label_documents"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    above, *below = plan.split("MapInArrow")
    assert len(below) == 1 and "Exchange" not in above and "Exchange" in below[0]


def test_labels_list_boxes_of_texts_images_and_nothing(spark):
    parts = spark.createDataFrame([("a", "0", "ab", 0.0, None, None), ("a", "1", None, 0.0, None, None), ("a", "2", "", 0.0, None, None), ("b", "0", "c", 7.0, 9.0, 7.0), ("b", "1", None, 7.0, 9.0, 7.0)], "id string, element string, boxed string, y0 double, width double, height double")
    got = {(r.id, r.element): (r.n_lines, r.lines, r.n_chars) for r in derived.label_lists(parts).collect()}
    assert got == {("a", "0"): (1, "ab@-2,-10,42,30", 2), ("a", "1"): (0, "", 0), ("a", "2"): (0, "", 0), ("b", "0"): (2, "@0,0,18,14;c@-2,14,20,20", 1), ("b", "1"): (1, "@0,0,18,14", 0)}
