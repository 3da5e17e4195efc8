"""Sizes of images from the first bytes of their files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """The number in size bytes from a place (counted from 1) on; null beyond the end."""
    at = at if isinstance(at, Column) else F.lit(at)
    byte = lambda k: F.hex(F.substring(content, at + k, F.lit(1)))
    order = range(size - 1, -1, -1) if little else range(size)
    there = F.octet_length(content) >= at + (size - 1)
    return F.when(there, F.conv(F.concat(*[byte(k) for k in order]), 16, 10).cast("bigint"))


def _jpeg(content: Column, segments: int) -> Column:
    """Width and height in the frame header of a JPEG: segments are skipped by their lengths, fill bytes one by one."""
    state = lambda at, width, height, done: F.struct(at.cast("bigint").alias("at"), width.cast("bigint").alias("width"), height.cast("bigint").alias("height"), done.alias("done"))
    none = F.lit(None)

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        mark, kind = _number(content, at, 1), _number(content, at + 1, 1)
        # frames are C0 to CF but for tables (C4), extensions (C8) and arithmetic conditioning (CC)
        frame = (kind >= 0xC0) & (kind <= 0xCF) & ~kind.isin(0xC4, 0xC8, 0xCC)
        end = mark.isNull() | (mark != 0xFF) | kind.isNull() | kind.isin(0xD9, 0xDA)
        found = state(at, _number(content, at + 7, 2), _number(content, at + 5, 2), F.lit(True))
        alone = (kind >= 0xD0) & (kind <= 0xD8) | (kind == 1)
        on = F.when(kind == 0xFF, at + 1).when(alone, at + 2).otherwise(at + 2 + _number(content, at + 2, 2))
        return F.when(s["done"], s).when(end | on.isNull(), state(at, none, none, F.lit(True))).when(frame, found).otherwise(state(on, none, none, F.lit(False)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(segments)), state(F.lit(3), none, none, F.lit(False)), step)


def image_size(content: Column, segments: int = 512) -> Column:
    """type (png, jpeg or bmp), width and height of an image's bytes; all null for other or cut-off bytes and for nulls.

    Headers are read, pixels are not. Of a JPEG, segments markers and fill bytes are looked at before the frame.
    """
    start = F.hex(F.substring(content, 1, 8))
    png, jpeg, bmp = start == "89504E470D0A1A0A", start.startswith("FFD8FF"), start.startswith("424D")
    frame = F.when(jpeg, _jpeg(content, segments))
    signed = lambda n: F.abs(F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n))
    width = F.when(png, _number(content, 17, 4)).when(jpeg, frame["width"]).when(bmp, signed(_number(content, 19, 4, True)))
    height = F.when(png, _number(content, 21, 4)).when(jpeg, frame["height"]).when(bmp, signed(_number(content, 23, 4, True)))
    whole = width.isNotNull() & height.isNotNull()
    kind = F.when(png, "png").when(jpeg, "jpeg").when(bmp, "bmp")
    return F.struct(F.when(whole, kind).alias("type"), F.when(whole, width).cast("int").alias("width"), F.when(whole, height).cast("int").alias("height"))
