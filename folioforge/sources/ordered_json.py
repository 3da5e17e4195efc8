"""JSON lines with the place of every line, so that rows of many files and splits have an order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import resolve


class _Split(InputPartition):
    def __init__(self, number: int, uri: str, start: int, end: int):
        self.number, self.uri, self.start, self.end = number, uri, start, end


def _lines(file, start: int, end: int, chunk: int) -> Iterator[tuple[int, bytes]]:
    """(offset, whole lines with their ends) of the lines that begin in [start, end), in pieces of about a chunk."""
    at, rest = start, b""
    if start:  # the line that holds the byte before start belongs to the split before
        at = start - 1
        file.seek(at)
        while True:
            data = file.read(chunk)
            cut = data.find(b"\n")
            if cut >= 0 or not data:
                break
            at += len(data)
        if not data:
            return
        at, rest = at + cut + 1, data[cut + 1 :]
    while at < end:
        last = rest.rfind(b"\n") + 1
        while not last:
            data = file.read(chunk)
            if not data:
                break
            rest += data
            last = rest.rfind(b"\n") + 1
        whole, rest = (rest[:last], rest[last:]) if last else (rest, b"")
        if not whole:
            return
        if at + len(whole) > end:  # lines that begin at end or later are of the next split
            over = whole.find(b"\n", max(0, end - at - 1))
            whole = whole if over < 0 else whole[: over + 1]
            yield at, whole
            return
        yield at, whole
        at += len(whole)


class OrderedLines(DataSource):
    """file (its number in the list), offset (of its first byte) and value of every line that is not blank."""

    @classmethod
    def name(cls) -> str:
        return "folioforge_lines"

    def schema(self) -> str:
        return "file int, offset bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]), int(self.options.get("splitbytes", 64 << 20)))


class _Reader(DataSourceReader):
    def __init__(self, uris: list[str], size: int):
        self.uris, self.size = uris, size

    def partitions(self) -> list[_Split]:
        found = []
        for number, uri in enumerate(self.uris):
            system, path = resolve(uri)
            length = system.get_file_info(path).size
            found += [_Split(number, uri, at, min(at + self.size, length)) for at in range(0, length, self.size)]
        return found or [_Split(0, "", 0, 0)]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        if not split.uri:
            return
        system, path = resolve(split.uri)
        with system.open_input_file(path) as file:
            for at, data in _lines(file, split.start, split.end, 1 << 20):
                raw = np.frombuffer(data, np.uint8)
                ends = np.flatnonzero(raw == 10)
                begins = np.concatenate([[0], ends + 1]).astype(np.int64)
                begins = begins[begins < len(raw)]
                bounds = np.append(begins, len(raw)).astype(np.int32)
                values = pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(data))
                values = pc.utf8_trim_whitespace(values)
                batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(begins), split.number, np.int32)), pa.array(at + begins), values], names=["file", "offset", "value"])
                yield batch.filter(pc.greater(pc.binary_length(values), 0))


def _files(uri: str, suffix: tuple[str, ...]) -> list[str]:
    """A file, or the files of a folder by name; hidden ones and markers are left out."""
    system, path = resolve(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [uri]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(uri)
    names = [i.base_name for i in system.get_file_info(fs.FileSelector(path)) if i.is_file]
    return [f"{uri.rstrip('/')}/{n}" for n in sorted(names) if n[0] not in "._" and n.endswith(suffix)]


def ordered_lines(spark: SparkSession, paths: str | list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """file, offset and value of the lines of files, or of folders' files by name, in the order given.

    Files are split by bytes; a line belongs to the split in which it begins and is read whole, however long.
    (file, offset) orders all rows. Blank lines are left out; no file gives no row. Paths are URIs or local paths, uncompressed.
    """
    paths = [paths] if isinstance(paths, str) else paths
    spark.dataSource.register(OrderedLines)
    files = [f for p in paths for f in _files(p, (".json", ".jsonl", ".txt"))]
    return spark.read.format("folioforge_lines").option("files", json.dumps(files)).option("splitBytes", str(split_bytes)).load()


def ordered_json(spark: SparkSession, paths: str | list[str], schema: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Rows of JSON lines with file and offset, which order them; files of one call append. A line that is no JSON object of the schema is an error."""
    rows = ordered_lines(spark, paths, split_bytes)
    return rows.select("file", "offset", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("file", "offset", "row.*")
