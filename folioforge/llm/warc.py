"""Operator 8, deterministic sharded WARC writer and its reader.

Records are range-sorted by page id in one shuffle, into which a small table (the
response that each duplicate payload refers to) is merged, so payloads move once.
Each task writes gzip members, rolls its file at a compressed size, regenerates
headers and digests, and commits every file under a temporary name; the saved
manifest lists the committed files, and readers read only those. Names, record
ids and dates are functions of the input, so a retried task writes the same bytes.

Defined cases: null and empty payloads are empty; equal payloads of at least
`min_payload` bytes have one response, the largest page id, and of rows that
repeat that id the first in order of their URLs; null URLs are written as an
empty target; control characters and spaces of URLs are percent-encoded; an
empty table makes no files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, new_path, save
from .files import committed, reading

FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")  # the public name space of object identifiers
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, payload_digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{payload_digest}/{kind}')}>"


def _clean_uri(uri: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in uri)


def encode_record(page_id, uri: str, payload: bytes, payload_digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record; refers_to: page id of the response that a revisit repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, payload_digest, kind)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean_uri(uri)}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, payload_digest, 'response')}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _warcinfo(name: str) -> bytes:
    body = b"software: folioforge\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name, '', 'warcinfo')}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member without time or name."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_records(file, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record, member by member."""
    data, ended = b"", False
    while True:
        unpacker, out = zlib.decompressobj(31), bytearray()
        while not unpacker.eof:
            if not data and not ended:
                data = file.read(chunk)
                ended = not data
            if not data:
                break
            out += unpacker.decompress(data)
            data = unpacker.unused_data
        if not out:
            return
        head, _, rest = bytes(out).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(headers["content-length"])
        if lines[0] != "WARC/1.1" or len(rest) != size + 4:
            raise ValueError(f"broken record {headers.get('warc-record-id')}")
        yield headers, rest[:size]


_MANIFEST = "part long, piece long, uri string, records long, bytes long, sha1 string"


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        buffer: list[bytes] = []
        size = records = 0

        def flush() -> pa.RecordBatch:
            nonlocal piece, size, records
            name = f"part-{part:06d}-{piece:04d}.warc.gz"
            info = member(_warcinfo(name))
            checksum = hashlib.sha1(info)
            with committed(f"{folder}/{name}") as out:
                out.write(info)
                for x in buffer:
                    out.write(x)
                    checksum.update(x)
            row = {"part": part, "piece": piece, "uri": f"{folder}/{name}", "records": records, "bytes": size + len(info), "sha1": checksum.hexdigest()}
            buffer.clear()
            piece, size, records = piece + 1, 0, 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("piece", pa.int64()), ("uri", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

        page, refers, answered = None, {}, set()
        for batch in batches:
            for page_id, kind, sha1, refers_to, uri, html in zip(*(c.to_pylist() for c in batch.columns)):
                if page_id != page:
                    page, refers, answered = page_id, {}, set()
                if kind == 0:
                    refers[sha1] = refers_to
                    continue
                payload = (html or "").encode()
                raw = hashlib.sha1(payload)
                shared = raw.hexdigest()
                target = refers.get(shared)
                if target == page_id and shared not in answered:  # this row is the response
                    answered.add(shared)
                    target = None
                data = member(encode_record(page_id, uri or "", payload, base64.b32encode(raw.digest()).decode(), target))
                buffer.append(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    yield flush()
        if buffer:
            yield flush()

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda x: int(x) if x else None
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = []
            with reading(uri) as file:
                for headers, block in read_records(file):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    if digest(block) != headers["warc-block-digest"].removeprefix("sha1:"):
                        raise ValueError(f"block digest differs: {headers['warc-record-id']}")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.decode().rpartition("Content-Length: ")[2])
                    payload_digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if headers["warc-type"] == "response" and (len(payload) != length or digest(payload) != payload_digest):
                        raise ValueError(f"payload differs: {headers['warc-record-id']}")
                    rows.append({"page_id": number(headers["x-page-id"]), "payload_bytes": length, "payload_digest": payload_digest, "record_type": headers["warc-type"], "refers_to": number(headers.get("x-refers-to-page-id"))})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)


def write_archives(pages: DataFrame, min_payload: int = 0, file_bytes: int = FILE_BYTES, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record; returns the manifest of committed files."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "archives")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    sums = save(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").alias("n")), "payload-digests")
    shared = sums.where(F.col("n") >= min_payload).groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("times")).where("times > 1")
    # a third of all rows may share one payload; the join splits by AQE, no row carries a payload
    meta = sums.join(shared, "sha1").select("page_id", F.lit(0).alias("kind"), "sha1", F.col("response").alias("refers_to"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")).dropDuplicates(["page_id", "sha1"])
    records = rows.select("page_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    ordered = meta.union(records).repartitionByRange("page_id").sortWithinPartitions("page_id", "kind", "url")
    return save(ordered.mapInArrow(lean(_writer(folder, file_bytes)), _MANIFEST), "archive-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, digests checked."""
    files = max(1, manifest.count())
    return manifest.select("uri").repartition(files).mapInArrow(lean(_reader), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as s from pages),
m as (select s, max(page_id) as top, count(*) as n from p group by s)
select page_id, octet_length(encode(h))::bigint as payload_bytes,
  (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1), '' order by i) from range(32) t(i)) as payload_digest,
  case when n > 1 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when n > 1 and page_id <> top then top end as refers_to
from p join m using (s)
"""
