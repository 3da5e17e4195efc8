"""Image sizes from headers."""

import struct

from pyspark.sql import functions as F

from folioforge.functions.images import image_size


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\0\0\0" + b"\0" * 20


def bmp(w, h):
    return b"BM" + struct.pack("<IHHIIii", 100, 0, 0, 54, 40, w, h) + b"\0" * 30


def jpeg(w, h, kind=0xC0, before=()):
    out = b"\xff\xd8"
    for marker, size in before:
        out += b"\xff" * 3 + bytes([marker]) + struct.pack(">H", size + 2) + b"\xff\xc0" * (size // 2) + b"\0" * (size % 2)
    return out + bytes([0xFF, kind]) + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9


CASES = {
    "png": (png(1024, 70_000), ("png", 1024, 70_000)),
    "bmp": (bmp(640, 480), ("bmp", 640, 480)),
    "top-down bmp": (bmp(640, -480), ("bmp", 640, 480)),
    "jpeg": (jpeg(1280, 720), ("jpeg", 1280, 720)),
    "progressive": (jpeg(3, 65_535, 0xC2, [(0xE0, 14), (0xE1, 60_001), (0xDB, 65), (0xC4, 30), (0xFE, 0)]), ("jpeg", 3, 65_535)),
    "cut": (jpeg(5, 5, 0xC0, [(0xE1, 100)])[:60], (None, None, None)),
    "cut png": (png(5, 5)[:22], (None, None, None)),
    "scan first": (b"\xff\xd8\xff\xda" + jpeg(5, 5)[2:], (None, None, None)),
    "other": (b"GIF89a" + b"\1" * 30, (None, None, None)),
    "empty": (b"", (None, None, None)),
    "null": (None, (None, None, None)),
}


def test_sizes(spark):
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, (v, _) in CASES.items()], "k string, content binary")
    got = {r.k: tuple(r.s) for r in rows.select("k", image_size(F.col("content")).alias("s")).collect()}
    assert got == {k: want for k, (_, want) in CASES.items()}


def test_sizes_of_files(spark, tmp_path):
    from folioforge.sources import readers

    for k in ("png", "jpeg"):
        (tmp_path / f"a.{k}").write_bytes(CASES[k][0])
    got = {r.path.rpartition(".")[2]: tuple(r.s) for r in readers.images(spark, str(tmp_path)).withColumn("s", image_size(F.col("content"))).collect()}
    assert got == {k: CASES[k][1] for k in ("png", "jpeg")}
