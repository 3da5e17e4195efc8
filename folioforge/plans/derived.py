"""Box tables that the queries derive from documents by a stated rule, in Spark and in SQL.

Characters stand 20 to a row, ten units apart, shifted by -1 to 1 across and by -5, 0 or 5 down,
so that centres fall inside lines, on their borders and between two of them. Blanks have no
width. A line is 10, 15 or 20 high, so lines overlap; every fourth is narrower and
every seventh has no height.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.boxes import CHARS, LINES, captions_in, lines_in, sized_in, totals_in


def _char(text: Column, k: Column, y0: Column) -> dict[str, Column]:
    x = (k % 20) * 10 + k % 3 - 1
    y = y0 + F.floor(k / 20) * 10 + F.when(k % 4 == 1, -5).when(k % 4 == 3, 5).otherwise(0)
    return {"x": x.cast("double"), "y": y.cast("double"), "width": F.when(text == " ", 0.0).otherwise(10.0), "height": F.lit(10.0), "text": text}


def _line(r: Column, y0: Column) -> dict[str, Column]:
    height = F.when(r % 7 == 6, 0).otherwise(10 + 5 * (r % 3))
    return {"x": F.lit(0.0), "y": (y0 + 10 * r).cast("double"), "width": F.when(r % 4 == 3, 160.0).otherwise(200.0), "height": height.cast("double")}


def char_boxes(nodes: DataFrame) -> DataFrame:
    """id, element, ord, x, y, width, height, text of the characters of nodes (id, element, content, y0)."""
    chars = nodes.where("content <> ''").select("id", "element", "y0", F.posexplode(F.split("content", "")).alias("ord", "text")).where("text <> ''")
    return chars.select("id", "element", "ord", *[c.alias(name) for name, c in _char(F.col("text"), F.col("ord"), F.col("y0")).items()])


def _rows() -> Column:
    return F.sequence(F.lit(0), F.floor((F.length("content") - 1) / 20).cast("int"))


def line_boxes(nodes: DataFrame) -> DataFrame:
    rows = nodes.where("content <> ''").select("id", "element", "y0", F.explode(_rows()).alias("line"))
    return rows.select("id", "element", "line", *[c.alias(name) for name, c in _line(F.col("line"), F.col("y0")).items()])


def _arrays(contents: pa.Array, y0: pa.Array) -> pa.Array:
    """The same boxes as arrays, for many contents at once."""
    listed = lambda counts, fields, names: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays([f if isinstance(f, pa.Array) else pa.array(f) for f in fields], names))
    top = y0.to_numpy(zero_copy_only=False)
    data = "".join(contents.to_pylist()).encode()
    points = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(points & 0xC0 != 0x80)
    texts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data))
    counts = pc.utf8_length(contents).to_numpy(zero_copy_only=False).astype(np.int64)
    number = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    k, ten = number(counts), np.full(len(starts), 10.0)
    y = np.repeat(top, counts) + k // 20 * 10 + np.array([0.0, -5.0, 0.0, 5.0])[k % 4]
    chars = listed(counts, [(k % 20 * 10 + k % 3 - 1).astype(float), y, np.where(points[starts] == 32, 0.0, 10.0), ten, texts], ["x", "y", "width", "height", "text"])
    rows = (counts + 19) // 20
    r = number(rows)
    lines = listed(rows, [np.zeros(len(r)), np.repeat(top, rows) + 10.0 * r, np.where(r % 4 == 3, 160.0, 200.0), np.where(r % 7 == 6, 0.0, 10.0 + 5 * (r % 3))], ["x", "y", "width", "height"])
    return pa.StructArray.from_arrays([chars, lines], ["chars", "lines"])


def _over(nodes: DataFrame, columns: dict[str, str], of: Callable[[pa.Array], tuple[np.ndarray | None, list[pa.Array]]]) -> DataFrame:
    """Columns made of the boxes of nodes with content, beside their other columns, or rows of nodes by number; 256,000 characters at a time."""
    rows = nodes.where("content <> ''").withColumn("y0", F.col("y0").cast("double"))
    names = [c for c in nodes.columns if c not in ("content", "y0")]
    kept = rows.select(*names, "content", "y0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            which, made = of(_arrays(part.column("content"), part.column("y0")))
            beside = part.columns[:-2] if which is None else [c.take(pa.array(which)) for c in part.columns[:-2]]
            yield pa.RecordBatch.from_arrays([*beside, *made], names=[*names, *columns])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names] + [f"{k} {v}" for k, v in columns.items()]
    return kept.mapInArrow(run, ", ".join(kinds))


def _parts(batches: Iterator[pa.RecordBatch], column: str = "content") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(4096, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).column(column).nbytes > 1 << 18:
                n //= 2
            yield batch.slice(at, n)
            at += n


def box_records(nodes: DataFrame) -> DataFrame:
    """One record an element with content: the nodes' other columns and boxes, a struct of the arrays chars and lines."""
    return _over(nodes, {"chars": CHARS, "lines": LINES}, lambda boxes: (None, boxes.flatten())).withColumn("boxes", F.struct("chars", "lines"))


def box_totals(nodes: DataFrame) -> DataFrame:
    """Number, sums and text of the characters with an area of nodes with content."""
    return _over(nodes, {"n_boxes": "bigint", "sum_x": "double", "sum_y": "double", "text": "string"}, lambda boxes: (None, list(totals_in(boxes.field("chars")).values())))


def line_rows(nodes: DataFrame, text: bool = True, box: bool = True) -> DataFrame:
    """A row for every line with an area of nodes with content: line, tight box and text as records_of finds them, of which only those asked for are made."""
    sides = {k: "double" for k in ("x", "y", "width", "height")} if box else {}

    def rows(boxes: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        owner, found = lines_in(*boxes.flatten(), text=text, box=box)
        return owner, list(found.values())

    return _over(nodes, {"line": "int", **sides, **({"text": "string"} if text else {})}, rows)


def _halves(values: np.ndarray) -> pa.Array:
    """Numbers in half units as texts."""
    n = (2 * values).astype(np.int64)
    low, high = (int(n.min()), int(n.max())) if len(n) else (0, 0)
    if high - low > len(n) + 1000:
        return pa.array(n).cast(pa.string())
    return pa.array(np.arange(low, high + 1)).cast(pa.string()).take(pa.array(n - low))


def _shown(sides: list[np.ndarray], texts: pa.Array) -> pa.Array:
    """Every box as text@x,y,width,height in half units."""
    return pc.binary_join_element_wise(texts, pc.binary_join_element_wise(*map(_halves, sides), ","), "@")


def _listed(sides: list[np.ndarray], texts: pa.Array, counts: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), _shown(sides, texts)), ";")


def _sides(found: dict[str, pa.Array]) -> list[np.ndarray]:
    return [found[k].to_numpy(zero_copy_only=False) for k in ("x", "y", "width", "height")]


def label_lists(parts: DataFrame) -> DataFrame:
    """Adds n_lines, lines, n_chars and chars_md5 to the parts of label documents: their boxes as texts, those of characters as a digest.

    boxed is the text that has boxes (null: none) from y0 down; parts with a width and a height are images, whose own box
    without text comes before the caption's one line. boxed, y0, width and height are dropped. A part's boxes are made, joined and listed in one place.
    """
    names = [c for c in parts.columns if c not in ("boxed", "y0", "width", "height")]
    kept = parts.select(*names, F.coalesce("boxed", F.lit("")).alias("boxed"), *[F.col(k).cast("double").alias(k) for k in ("y0", "width", "height")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, "boxed"):
            image = batch.column("width").is_valid()
            for part, of_images in ((batch.filter(pc.invert(image)), False), (batch.filter(image), True)):
                if not part.num_rows:
                    continue
                chars, lines = _arrays(part.column("boxed"), part.column("y0")).flatten()
                if of_images:
                    owner, found = captions_in(chars, lines)
                    size = [part.column(k).to_numpy(zero_copy_only=False) for k in ("width", "height")]
                    own = _shown([np.zeros(len(part)), np.zeros(len(part)), *size], pa.array([""] * len(part)))
                    listed = own.to_pylist()
                    for at, caption in zip(owner.tolist(), _shown(_sides(found), found["text"]).to_pylist()):
                        listed[at] += ";" + caption
                    listed, n_lines = pa.array(listed, pa.string()), 1 + np.bincount(owner, minlength=len(part))
                else:
                    owner, found = lines_in(chars, lines)
                    n_lines = np.bincount(owner, minlength=len(part))
                    listed = _listed(_sides(found), found["text"], n_lines)
                n_chars, sides, texts = sized_in(chars)
                digests = [hashlib.md5(t).hexdigest() for t in _listed(sides, texts, n_chars).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-4], pa.array(n_lines.astype(np.int32)), listed, pa.array(n_chars.astype(np.int32)), pa.array(digests, pa.string())], names=[*names, "n_lines", "lines", "n_chars", "chars_md5"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names]
    return kept.mapInArrow(run, ", ".join([*kinds, "n_lines int", "lines string", "n_chars int", "chars_md5 string"]))


def image_bytes(kind: Column, width: Column, height: Column) -> Column:
    """The first bytes of a PNG (kind 0), a JPEG with two segments before its frame (1) or a BMP (2) of a size."""
    big = lambda n, size: F.lpad(F.hex(n.cast("bigint")), 2 * size, "0")
    little = lambda n: F.concat(*[F.substring(big(n, 4), at, 2) for at in (7, 5, 3, 1)])
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(width, 4), big(height, 4), F.lit("0802000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFDB0043" + "01" * 65 + "FFC0001108"), big(height, 2), big(width, 2), F.lit("03012200021101031101"))
    bmp = F.concat(F.lit("424D" + "00" * 8 + "3600000028000000"), little(width), little(height), F.lit("01001800"))
    return F.unhex(F.when(kind == 0, png).when(kind == 1, jpeg).otherwise(bmp))


#: Box tables over a table expression node (id, element, content, y0): all of them, then those with an area.
SQL = """all_chars as (select id, element, (k - 1)::int as ord, ((k - 1) % 20 * 10 + (k - 1) % 3 - 1)::double as x, (y0 + (k - 1) // 20 * 10 + [0, -5, 0, 5][1 + (k - 1) % 4])::double as y,
  case when substr(content, k, 1) = ' ' then 0.0 else 10.0 end::double as width, 10.0::double as height, substr(content, k, 1) as text from (select *, unnest(range(1, len(content) + 1)) as k from node where content <> '')),
all_lines as (select id, element, r::int as line, 0.0::double as x, (y0 + 10 * r)::double as y, case when r % 4 = 3 then 160.0 else 200.0 end::double as width, (case when r % 7 = 6 then 0 else 10 + 5 * (r % 3) end)::double as height
  from (select *, unnest(range((len(content) - 1) // 20 + 1)) as r from node where content <> '')),
chars as (select * from all_chars where width > 0 and height > 0), lines as (select * from all_lines where width > 0 and height > 0),
held as (select c.id, c.element, c.ord, any_value(c.text) as text, min(l.line) as line from chars c join lines l on c.id = l.id and c.element = l.element
  and c.x + c.width / 2 between l.x and l.x + l.width and c.y + c.height / 2 between l.y and l.y + l.height group by c.id, c.element, c.ord),
line_text as (select id, element, line, string_agg(text, '' order by ord) as text from held group by id, element, line),
tight as (select l.id, l.element, l.line, coalesce(min(c.x), any_value(l.x)) as x, coalesce(min(c.y), any_value(l.y)) as y,
  coalesce(max(c.x + c.width) - min(c.x), any_value(l.width)) as width, coalesce(max(c.y + c.height) - min(c.y), any_value(l.height)) as height
  from lines l left join chars c on c.id = l.id and c.element = l.element and c.x < l.x + l.width and c.x + c.width > l.x and c.y < l.y + l.height and c.y + c.height > l.y
  group by l.id, l.element, l.line)"""
