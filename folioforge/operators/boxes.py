"""Boxes of characters and lines: spatial joins by grid cells, and label records rebuilt from narrow rows.

Boxes are rows of x, y, width and height with keys that name their element. Two
boxes meet only in a cell of the page that both touch, so the work follows the
number of boxes, however many of them one element has, and an element's boxes
spread over tasks by cell. Boxes without an area, or with nulls, take part in nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width and height of a cell, about a line's.
CELL = (256.0, 32.0)
BOXES = "array<struct<x:double,y:double,width:double,height:double,text:string>>"
KEYS = ("id", "element")


def positive(boxes: DataFrame) -> DataFrame:
    return boxes.where("width > 0 and height > 0")


def _cell(at: Column, size: float) -> Column:
    return F.floor(at / size).cast("bigint")


def _touched(boxes: DataFrame, cell: tuple[float, float]) -> DataFrame:
    """A row for every cell that a box touches, borders included."""
    (x, x2), (y, y2) = (_cell(F.col("x"), cell[0]), _cell(F.col("x") + F.col("width"), cell[0])), (_cell(F.col("y"), cell[1]), _cell(F.col("y") + F.col("height"), cell[1]))
    wide = x2 - x + 1
    at = boxes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), wide * (y2 - y + 1) - 1)))
    return at.withColumns({"cx": x + F.col("k") % wide, "cy": y + F.floor(F.col("k") / wide)}).drop("k")


def _ends() -> list[Column]:
    return [c.alias(n) for n, c in {"lx": F.col("x"), "ly": F.col("y"), "lx2": F.col("x") + F.col("width"), "ly2": F.col("y") + F.col("height")}.items()]


def chars_to_lines(chars: DataFrame, lines: DataFrame, keys: tuple[str, ...] = KEYS, cell: tuple[float, float] = CELL) -> DataFrame:
    """keys, ord, text and line: the first line whose box holds a character's centre, borders included; characters in no line are left out.

    Only the centre's cell is looked at, since every line around the centre touches it. A cell's
    lines, few as they overlap there, are one row; so a character meets one row and is not grouped.
    """
    mx, my = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    c = positive(chars).select(*keys, "ord", "text", mx.alias("mx"), my.alias("my"), _cell(mx, cell[0]).alias("cx"), _cell(my, cell[1]).alias("cy"))
    at = _touched(positive(lines).select(*keys, "line", "x", "y", "width", "height"), cell)
    in_cell = at.groupBy(*keys, "cx", "cy").agg(F.array_sort(F.collect_list(F.struct("line", *_ends()))).alias("lines"))
    joined = c.join(in_cell.hint("shuffle_hash"), [*keys, "cx", "cy"])
    inside = F.filter("lines", lambda ln: (F.col("mx") >= ln["lx"]) & (F.col("mx") <= ln["lx2"]) & (F.col("my") >= ln["ly"]) & (F.col("my") <= ln["ly2"]))
    return joined.select(*keys, "ord", "text", F.get(inside, F.lit(0))["line"].alias("line")).where("line is not null")


def cut_boxes(chars: DataFrame, lines: DataFrame, keys: tuple[str, ...] = KEYS, cell: tuple[float, float] = CELL) -> DataFrame:
    """keys, line and the character's ends (x, y, x2, y2) for every pair that overlaps in an area.

    A pair may share several cells; it counts in the one that holds the corner where the overlap begins.
    """
    c = _touched(positive(chars).select(*keys, "x", "y", "width", "height"), cell)
    # lines are far fewer than characters: the side to hash
    at = _touched(positive(lines).select(*keys, "line", "x", "y", "width", "height"), cell).select(*keys, "cx", "cy", "line", *_ends()).hint("shuffle_hash")
    joined = c.join(at, [*keys, "cx", "cy"])
    x2, y2 = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    cut = (F.col("x") < F.col("lx2")) & (x2 > F.col("lx")) & (F.col("y") < F.col("ly2")) & (y2 > F.col("ly"))
    here = (_cell(F.greatest("x", "lx"), cell[0]) == F.col("cx")) & (_cell(F.greatest("y", "ly"), cell[1]) == F.col("cy"))
    return joined.where(cut & here).select(*keys, "line", "x", "y", x2.alias("x2"), y2.alias("y2"))


def _ordered_text() -> Column:
    parts = F.array_sort(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", "text"))))
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def line_texts(assigned: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, line and text of the lines that have characters, joined by place."""
    return assigned.groupBy(*keys, "line").agg(_ordered_text().alias("text"))


def _tight(own: dict[str, Column]) -> list[Column]:
    """The least box over cut characters, or the own one where there are none."""
    x, y = F.min("x"), F.min("y")
    found = {"x": x, "y": y, "width": F.max("x2") - x, "height": F.max("y2") - y}
    return [F.coalesce(found[k], own[k]).alias(k) for k in found]


def _own(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return positive(lines).select(*keys, "line", *[F.col(k).alias(f"own_{k}") for k in ("x", "y", "width", "height")])


def tight_lines(chars: DataFrame, lines: DataFrame, keys: tuple[str, ...] = KEYS, cell: tuple[float, float] = CELL) -> DataFrame:
    """Least box over the characters that a line's box cuts; lines without any keep their own. Line numbers are unique within their keys."""
    rows = cut_boxes(chars, lines, keys, cell).unionByName(_own(lines, keys), allowMissingColumns=True)
    return rows.groupBy(*keys, "line").agg(*_tight({k: F.max(f"own_{k}") for k in ("x", "y", "width", "height")}))


def line_records(chars: DataFrame, lines: DataFrame, keys: tuple[str, ...] = KEYS, cell: tuple[float, float] = CELL) -> DataFrame:
    """keys, line, x, y, width, height and text: every line with its tight box and the text of its characters, in one grouping."""
    texts = chars_to_lines(chars, lines, keys, cell)
    rows = cut_boxes(chars, lines, keys, cell).unionByName(texts, allowMissingColumns=True).unionByName(_own(lines, keys), allowMissingColumns=True)
    return rows.groupBy(*keys, "line").agg(*_tight({k: F.max(f"own_{k}") for k in ("x", "y", "width", "height")}), _ordered_text().alias("text"))


def union_box(lines: DataFrame, *keys: str) -> DataFrame:
    x0, y0 = F.min("x"), F.min("y")
    return lines.groupBy(*keys).agg(x0.alias("x"), y0.alias("y"), (F.max(F.col("x") + F.col("width")) - x0).alias("width"), (F.max(F.col("y") + F.col("height")) - y0).alias("height"))


def caption_records(chars: DataFrame, lines: DataFrame, line: int = 1, keys: tuple[str, ...] = KEYS, cell: tuple[float, float] = CELL) -> DataFrame:
    """One line a caption: the union of its lines, drawn tight over the characters that it cuts, with the lines' texts in line order."""
    whole = union_box(positive(lines), *keys).withColumn("line", F.lit(line))
    parts = line_texts(chars_to_lines(chars, lines, keys, cell), keys).select(*keys, F.lit(line).alias("line"), F.col("line").alias("ord"), "text")
    rows = cut_boxes(chars, whole, keys, cell).unionByName(parts, allowMissingColumns=True).unionByName(_own(whole, keys), allowMissingColumns=True)
    return rows.groupBy(*keys, "line").agg(*_tight({k: F.max(f"own_{k}") for k in ("x", "y", "width", "height")}), _ordered_text().alias("text"))


# --- boxes as arrays of one record: nothing is shuffled

CHARS = BOXES
LINES = "array<struct<x:double,y:double,width:double,height:double>>"
RECORDS = "array<struct<line:int,x:double,y:double,width:double,height:double,text:string>>"


class _Boxes:
    """The boxes with an area of a batch of records, as numpy columns."""

    def __init__(self, lists: pa.Array):
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat = lists.flatten()
        x, y, width, height = (pc.fill_null(self.flat.field(k), float("nan")).to_numpy(zero_copy_only=False) for k in range(4))
        sized = (width > 0) & (height > 0) & np.isfinite(x + y + width + height)
        if self.flat.null_count:
            sized &= self.flat.is_valid().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)
        self.kept = np.flatnonzero(sized)
        self.place = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))[self.kept]
        self.owner, self.x, self.y = owner[self.kept], x[self.kept], y[self.kept]
        self.x2, self.y2 = self.x + width[self.kept], self.y + height[self.kept]


def _key(owner: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """A cell's key; it only brings candidates together, so two cells may share one."""
    return (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + cx.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + cy.astype(np.uint64)


def _cells_of(owner: np.ndarray, x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray, cell: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Box number, cell column, cell row and key of every cell touched, in order of boxes."""
    cx, cy = np.floor(x / cell[0]).astype(np.int64), np.floor(y / cell[1]).astype(np.int64)
    wide, high = np.floor(x2 / cell[0]).astype(np.int64) - cx + 1, np.floor(y2 / cell[1]).astype(np.int64) - cy + 1
    count = wide * high
    box = np.repeat(np.arange(len(owner)), count)
    several = np.flatnonzero((count > 1)[box])
    cx, cy, of, many = cx[box], cy[box], box[several], count > 1
    k = np.arange(len(several)) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
    cx[several] += k % wide[of]
    cy[several] += k // wide[of]
    return box, cx, cy, _key(owner[box], cx, cy)


def _ranges(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of every key in sorted_keys; neighbours of one key are looked up once."""
    run = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool))
    size = np.diff(np.append(run, len(keys)))
    return tuple(np.repeat(np.searchsorted(sorted_keys, keys[run], side), size) for side in ("left", "right"))


class _Grid:
    """Lines by the cells that they touch, in order of lines within a cell."""

    def __init__(self, ln: _Boxes, cell: tuple[float, float]):
        box, _, _, key = _cells_of(ln.owner, ln.x, ln.y, ln.x2, ln.y2, cell)
        order = np.argsort(key, kind="stable")
        self.cell, self.box, self.key = cell, box[order], key[order]
        self.owner, self.x, self.y, self.x2, self.y2 = (v[self.box] for v in (ln.owner, ln.x, ln.y, ln.x2, ln.y2))

    def first_around(self, c: _Boxes) -> np.ndarray:
        """The first line around every centre, or -1: all centres try the next line of their cell until they are in one."""
        mx, my = c.x + (c.x2 - c.x) / 2, c.y + (c.y2 - c.y) / 2
        at, end = _ranges(_key(c.owner, np.floor(mx / self.cell[0]).astype(np.int64), np.floor(my / self.cell[1]).astype(np.int64)), self.key)
        line, left = np.full(len(mx), -1), np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            px, py = mx[left], my[left]
            in_ = (py >= self.y[at]) & (py <= self.y2[at]) & (px >= self.x[at]) & (px <= self.x2[at])
            in_ &= c.owner[left] == self.owner[at]
            line[left[in_]] = self.box[at[in_]]
            at += 1
            more = np.flatnonzero(~in_ & (at < end))
            left, at, end = left[more], at[more], end[more]
        return line

    def tight(self, c: _Boxes, ends: list[np.ndarray]) -> list[np.ndarray]:
        """Least ends over the boxes that every line overlaps, or its own; a pair that meets in several cells changes nothing."""
        least = [np.full(len(ends[0]), far) for far in (np.inf, np.inf, -np.inf, -np.inf)]
        who, _, _, own = _cells_of(c.owner, c.x, c.y, c.x2, c.y2, self.cell)
        at, end = _ranges(own, self.key)
        left = np.flatnonzero(at < end)
        who, at, end = who[left], at[left], end[left]
        while len(who):
            cut = np.flatnonzero((c.y[who] < self.y2[at]) & (c.y2[who] > self.y[at]))
            i, k = who[cut], at[cut]
            cut = np.flatnonzero((c.x[i] < self.x2[k]) & (c.x2[i] > self.x[k]) & (c.owner[i] == self.owner[k]))
            i, j = i[cut], self.box[k[cut]]
            for found, values, reduce in zip(least, (c.x, c.y, c.x2, c.y2), (np.minimum, np.minimum, np.maximum, np.maximum)):
                reduce.at(found, j, values[i])
            at += 1
            more = np.flatnonzero(at < end)
            who, at, end = who[more], at[more], end[more]
        any_ = np.isfinite(least[0])
        return [np.where(any_, found, own) for found, own in zip(least, ends)]


def _joined(texts: pa.Array, counts: np.ndarray, between: str = "") -> pa.Array:
    """Texts end to end, so many for every row."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), texts), between)


def lines_in(chars: pa.Array, lines: pa.Array, cell: tuple[float, float] = CELL, text: bool = True, box: bool = True) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The lines with an area of many records: the record of each, and its number, tight box and text, of which only those asked for are made."""
    c, ln = _Boxes(chars), _Boxes(lines)
    grid = _Grid(ln, cell)
    out = {"line": pa.array(ln.place.astype(np.int32))}
    if box:
        x, y, x2, y2 = grid.tight(c, [ln.x, ln.y, ln.x2, ln.y2])
        out |= {"x": pa.array(x), "y": pa.array(y), "width": pa.array(x2 - x), "height": pa.array(y2 - y)}
    if text:
        line = grid.first_around(c)
        held = np.flatnonzero(line >= 0)
        line = line[held]
        texts = pc.fill_null(c.flat.field(4), "").take(pa.array(c.kept[held[np.argsort(line, kind="stable")]]))
        out["text"] = _joined(texts.cast(pa.string()), np.bincount(line, minlength=len(ln.owner)))
    return ln.owner, out


def _records(chars: pa.Array, lines: pa.Array, cell: tuple[float, float]) -> pa.Array:
    owner, found = lines_in(chars, lines, cell)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lines)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(found.values()), list(found)))


def sized_in(boxes: pa.Array) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """The boxes with an area of many records: how many every record has, their x, y, width and height, and their texts."""
    b = _Boxes(boxes)
    sides = [b.flat.field(k).to_numpy(zero_copy_only=False)[b.kept] for k in range(4)]
    return np.bincount(b.owner, minlength=len(boxes)), sides, pc.fill_null(b.flat.field(4), "").take(pa.array(b.kept)).cast(pa.string())


def totals_in(chars: pa.Array) -> dict[str, pa.Array]:
    """Number, sums of x and y and text of the boxes with an area of every record."""
    counts, (x, y, _, _), texts = sized_in(chars)
    owner = np.repeat(np.arange(len(counts)), counts)
    sums = [np.bincount(owner, v, minlength=len(counts)).astype(float) for v in (x, y)]
    return {"n_boxes": pa.array(counts), "sum_x": pa.array(sums[0]), "sum_y": pa.array(sums[1]), "text": _joined(texts, counts)}


def captions_in(chars: pa.Array, lines: pa.Array, cell: tuple[float, float] = CELL) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """with_caption for Arrow arrays: the records that have a caption, and its box and text."""
    ln, n = _Boxes(lines), len(lines)
    counts = np.bincount(ln.owner, minlength=n)
    some = np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)[some]
    x, y, x2, y2 = (f.reduceat(v, first) if len(first) else v for f, v in ((np.minimum, ln.x), (np.minimum, ln.y), (np.maximum, ln.x2), (np.maximum, ln.y2)))
    offsets = np.concatenate([[0], np.cumsum(counts > 0)]).astype(np.int32)
    whole = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(v) for v in (x, y, x2 - x, y2 - y)], ["x", "y", "width", "height"]))
    owner, found = lines_in(chars, whole, cell, text=False)
    texts = _joined(lines_in(chars, lines, cell, box=False)[1]["text"], counts)
    return owner, {k: found[k] for k in ("x", "y", "width", "height")} | {"text": texts.take(pa.array(owner))}


def records_of(boxes: str | Column, cell: tuple[float, float] = CELL) -> Column:
    """The lines of one record, each with its tight box and the text of its characters, as line_records finds them for rows.

    boxes is a struct of two arrays in their order, chars and lines (see CHARS and LINES); line numbers are places in the array,
    lines without an area are left out. A null array has no boxes. Records are joined by cells, many at once; nothing is shuffled,
    and the work follows the number of boxes.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            at, done = 0, []
            while at < len(rows):
                n = min(4096, len(rows) - at)
                while n > 1 and rows.slice(at, n).nbytes > 16 << 20:
                    n //= 2
                done.append(records_in(rows.slice(at, n), cell))
                at += n
            yield pa.concat_arrays(done) if done else records_in(rows, cell)

    column = F.col(boxes) if isinstance(boxes, str) else boxes
    return F.arrow_udf(run, RECORDS)(column)


def records_in(rows: pa.Array, cell: tuple[float, float] = CELL) -> pa.Array:
    """records_of for an Arrow array of boxes, for functions over Arrow batches that make boxes themselves."""
    return _records(*rows.flatten(), cell)


def paired(chars: str | Column, lines: str | Column) -> Column:
    """Two arrays of boxes as records_of takes them."""
    column = lambda x, kind: (F.col(x) if isinstance(x, str) else x).cast(kind)
    return F.struct(column(chars, CHARS).alias("chars"), column(lines, LINES).alias("lines"))


def nested(chars: DataFrame, lines: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows of boxes as records: keys, chars (in order of ord) and lines (in order of line), by one shuffle of narrow rows."""
    rows = chars.select(*keys, F.struct("ord", "x", "y", "width", "height", "text").alias("c")).unionByName(lines.select(*keys, F.struct("line", "x", "y", "width", "height").alias("l")), allowMissingColumns=True)
    bare = lambda array: F.transform(F.array_sort(array), lambda b: b.dropFields("ord" if array == "c" else "line"))
    return rows.groupBy(*keys).agg(F.collect_list("c").alias("c"), F.collect_list("l").alias("l")).select(*keys, bare("c").alias("chars"), bare("l").alias("lines"))


def whole(lines: str) -> Column:
    """The union of lines with an area as an array of one box, or of none."""
    kept = F.filter(lines, lambda b: (b["width"] > 0) & (b["height"] > 0))
    at = lambda f, end: f(F.transform(kept, end))
    x, y = at(F.array_min, lambda b: b["x"]), at(F.array_min, lambda b: b["y"])
    x2, y2 = at(F.array_max, lambda b: b["x"] + b["width"]), at(F.array_max, lambda b: b["y"] + b["height"])
    return F.filter(F.array(F.struct(x.alias("x"), y.alias("y"), (x2 - x).alias("width"), (y2 - y).alias("height"))), lambda b: b["x"].isNotNull())


def with_caption(records: DataFrame, chars: str = "chars", lines: str = "lines", out: str = "caption") -> DataFrame:
    """Adds the caption as one line: the union of its lines, tight over the characters that it cuts, with their texts in line order; null where there is no line."""
    found = records.withColumns({"folio_lines": records_of(paired(chars, lines)), "folio_whole": records_of(paired(chars, whole(lines)))})
    box = F.get("folio_whole", F.lit(0))
    text = F.array_join(F.transform("folio_lines", lambda ln: ln["text"]), "")
    return found.withColumn(out, F.when(box.isNotNull(), F.struct(*[box[k].alias(k) for k in ("x", "y", "width", "height")], text.alias("text")))).drop("folio_lines", "folio_whole")


# --- label records


def box_maps(records: DataFrame) -> DataFrame:
    """id and a map from element to its boxes, from one record (id, element, lines, chars) an element; characters without an area are left out."""
    chars = F.filter("chars", lambda b: (b["width"] > 0) & (b["height"] > 0))
    pair = F.struct("element", F.struct(F.col("lines").cast(BOXES).alias("lines"), chars.cast(BOXES).alias("chars")))
    return records.groupBy("id").agg(F.map_from_entries(F.collect_list(pair)).alias("boxes"))


def with_boxes(labels: DataFrame, records: DataFrame) -> DataFrame:
    """Adds bboxes and char_bboxes to every element, title_bboxes and title_char_bboxes to the record; empty arrays where there are no boxes.

    records (id, element, lines, chars) name elements by their place as text, or title, each once. Labels meet them once, by id; nulls and labels without any box stay.
    """
    joined = labels.join(box_maps(records).withColumnRenamed("boxes", "box_map"), "id", "left")
    none = F.array().cast(BOXES)
    got = lambda element, kind: F.coalesce(F.try_element_at("box_map", element)[kind], none)
    filled = F.transform("elements", lambda e, i: e.withField("bboxes", got(i.cast("string"), "lines")).withField("char_bboxes", got(i.cast("string"), "chars")))
    title = F.lit("title")
    return joined.withColumns({"elements": filled, "title_bboxes": got(title, "lines"), "title_char_bboxes": got(title, "chars")}).drop("box_map")
