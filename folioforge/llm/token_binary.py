"""Operator 5, token ids as one succinct file per shard.

Documents are range-partitioned and sorted by id; each task encodes its texts and
writes wavelet matrices: one bit plane for every bit of an id, each plane in
compressed blocks with the number of ones before every block. The file answers
token access, counting and occurrence lookup from the blocks it needs.

Defined cases: a null or empty text has just the end id; repeated ids follow one
another in the order of their texts, null ids come first; an empty table makes no
files and an empty result; a shard is rolled at SHARD_TOKENS, so no task holds an
unbounded number of ids beyond one document.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, new_path, save, slices
from .files import committed, reading
from .tokenizing import crc32, encoder, tokenizer_path, with_end

SHARD_TOKENS = 8_000_000
#: Bits of a plane that are compressed together; a multiple of 8.
BLOCK = 1 << 19
_MAGIC = b"WMX1"


def build(ids: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[int]]:
    """Bit planes from the highest bit down, and the number of zeros of each."""
    planes, zeros, order = [], [], ids
    for level in range(levels - 1, -1, -1):
        bits = (order >> level) & 1 != 0
        planes.append(np.packbits(bits))
        low = order[~bits]
        zeros.append(len(low))
        order = np.concatenate([low, order[bits]])
    return planes, zeros


def invert(planes: list[np.ndarray], zeros: list[int], n: int, dtype) -> np.ndarray:
    """The whole sequence from its planes."""
    values = np.zeros(n, dtype)
    for level, (plane, low) in enumerate(zip(reversed(planes), reversed(zeros))):
        bits = np.unpackbits(plane, count=n).astype(bool)
        before = np.empty_like(values)
        before[~bits] = values[:low]
        before[bits] = values[low:] | dtype(1 << level)
        values = before
    return values


def write_shard(out, ids: np.ndarray, doc_ids: list, counts: np.ndarray) -> None:
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    planes, zeros = build(ids.astype(np.uint16) if levels <= 16 else ids, levels)
    pack = zstandard.ZstdCompressor(level=1).compress
    at, blocks, ones = out.tell(), [], []
    at += out.write(_MAGIC) or len(_MAGIC)
    for plane in planes:
        offsets, before, total = [at], [0], 0
        for i in range(0, len(plane), BLOCK // 8):
            part = plane[i : i + BLOCK // 8]
            data = pack(part.tobytes())
            out.write(data)
            at += len(data)
            total += int(np.bitwise_count(part).sum())
            offsets.append(at)
            before.append(total)
        blocks.append(offsets)
        ones.append(before)
    head = pack(json.dumps({"n": len(ids), "zeros": zeros, "blocks": blocks, "ones": ones, "doc_ids": doc_ids, "counts": counts.tolist()}).encode())
    out.write(head)
    out.write(struct.pack("<Q", len(head)) + _MAGIC)


class TokenFile:
    """Reader of one shard over a seekable file."""

    def __init__(self, file):
        self.file = file
        size = file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2)
        file.seek(size - 12)
        length, magic = struct.unpack("<Q4s", file.read(12))
        if magic != _MAGIC:
            raise ValueError("not a token file")
        file.seek(size - 12 - length)
        head = json.loads(zstandard.ZstdDecompressor().decompress(file.read(length)))
        self.n, self.zeros, self.blocks, self.ones = head["n"], head["zeros"], head["blocks"], head["ones"]
        self.doc_ids, self.counts = head["doc_ids"], np.array(head["counts"], np.int64)
        self.levels = len(self.zeros)
        self.block = lru_cache(maxsize=256)(self._block)

    def _bytes(self, plane: int, block: int) -> bytes:
        a, b = self.blocks[plane][block : block + 2]
        self.file.seek(a)
        return zstandard.ZstdDecompressor().decompress(self.file.read(b - a))

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(np.frombuffer(self._bytes(plane, block), np.uint8))
        return bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits."""
        block, rest = divmod(i, BLOCK)
        return self.ones[plane][block] + (int(self.block(plane, block)[1][rest]) if rest else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.levels):
            bit = int(self.block(plane, i // BLOCK)[0][i % BLOCK])
            ones = self._ones(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _interval(self, symbol: int, stop: int) -> tuple[int, int]:
        a, b = 0, stop
        if symbol >> self.levels:
            return 0, 0
        for plane in range(self.levels):
            x, y = self._ones(plane, a), self._ones(plane, b)
            a, b = (self.zeros[plane] + x, self.zeros[plane] + y) if symbol >> (self.levels - 1 - plane) & 1 else (a - x, b - y)
        return a, b

    def rank(self, symbol: int, i: int) -> int:
        """How often symbol occurs among the first i ids."""
        a, b = self._interval(symbol, min(i, self.n))
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value."""
        ones = self.ones[plane]
        low, high = 0, len(ones) - 1
        before = (lambda b: ones[b]) if bit else (lambda b: b * BLOCK - ones[b])
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if before(mid) <= k else (low, mid)
        bits = self.block(plane, low)[0]
        return low * BLOCK + int(np.flatnonzero(bits == bit)[k - before(low)])

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of symbol."""
        a, b = self._interval(symbol, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for plane in range(self.levels - 1, -1, -1):
            bit = symbol >> (self.levels - 1 - plane) & 1
            i = self._select_bit(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def occurrences(self, symbol: int) -> Iterator[int]:
        return (self.select(symbol, k) for k in range(self.count(symbol)))

    def read_all(self) -> np.ndarray:
        planes = [np.frombuffer(b"".join(self._bytes(p, b) for b in range(len(self.blocks[p]) - 1)), np.uint8) for p in range(self.levels)]
        return invert(planes, self.zeros, self.n, np.uint16 if self.levels <= 16 else np.uint32)


_MANIFEST = "part long, piece long, uri string, n_docs long, n_tokens long"


def _writer(path: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, piece = encoder(path), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        docs: list = []

        def flush() -> pa.RecordBatch:
            nonlocal piece
            uri = f"{folder}/shard-{part:06d}-{piece:04d}.wmx"
            flat, each = np.concatenate(ids), np.concatenate(counts)
            with committed(uri) as out:
                write_shard(out, flat, docs, each)
            row = pa.RecordBatch.from_pylist([{"part": part, "piece": piece, "uri": uri, "n_docs": len(docs), "n_tokens": len(flat)}])
            piece += 1
            ids.clear(), counts.clear(), docs.clear()
            return row

        held = 0
        for batch in slices(batches):
            flat, each = with_end(*enc.encode(batch.column(1)), end_id)
            ids.append(flat), counts.append(each), docs.extend(batch.column(0).to_pylist())
            held += len(flat)
            if held >= SHARD_TOKENS:
                yield flush()
                held = 0
        if docs:
            yield flush()

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with reading(row["uri"]) as file:
                shard = TokenFile(file)
                ids = shard.read_all().astype("<u4")
            ends = np.cumsum(shard.counts)
            starts = ends - shard.counts
            crcs = [crc32(ids[a:b]) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + row["before"], pa.int64()), pa.array(shard.counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write every document's ids in ascending id order; returns the manifest (one row per file)."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-shards")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return save(ordered.mapInArrow(lean(_writer(tokenizer_path(tokenizer), folder, end_id)), _MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files.

    The manifest has one small row per file, so its running sum needs no partitioning.
    """
    spark = manifest.sparkSession
    before = F.sum("n_tokens").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1))
    located = manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    files = max(1, manifest.count())
    return located.repartition(files).mapInArrow(lean(_reader), "doc_id long, start long, n_tokens long, ids_crc32 long")
