"""Operator 9, token counts without ids.

Pieces are counted once per distinct pre-token (a run of spaces with the
characters up to the next space) and joined to each document's pre-token
frequencies. The join is split by frequency: the most frequent pre-tokens, a
number bounded by a parameter, are broadcast; every other occurrence is joined
by shuffle, so no pre-token is dropped and no hot key is shuffled.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows give
repeated results; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, row_uid, save, slices
from .tokenizing import tokenizer_path

#: Most distinct pre-tokens that are broadcast, and the longest one in characters: together they bound the broadcast.
HEAD, HEAD_CHARS = 300_000, 32
#: A task's map-side counts are flushed at this many distinct pre-tokens.
FLUSH = 400_000
_RUNS = re.compile(r" +[^ ]*")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text that has no U+2581, each without its first space."""
    parts = text.split(" ")
    if "" in parts:
        return [x[1:] for x in _RUNS.findall(" " + text)] if text else []
    return parts


def _whole(text: str) -> bool:
    """The mark that stands for a space makes a text's own spaces ambiguous; such texts are counted whole."""
    return "▁" in text


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["piece", "n"])
        counts.clear()
        return out

    for batch in slices(batches, rows=10_000):
        texts = batch.column(0)
        simple = pa.array([t for t in texts.to_pylist() if t and not _whole(t)], pa.large_string())
        doubled = pc.match_substring_regex(simple, r"  |^ | $")
        lists = pc.split_pattern(simple.filter(pc.invert(doubled)), " ")
        for x in lists.flatten().value_counts().to_pylist() if len(lists) else []:
            counts[x["values"]] += x["counts"]
        for text in simple.filter(doubled).to_pylist():
            counts.update(pre_tokens(text))
        if len(counts) > FLUSH:
            yield flush()
    yield flush()


def _piece_counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in slices(batches, rows=20_000):
            ids = model.encode(batch.column(0).to_pylist(), num_threads=1)  # "" stands for a last lone space, one piece
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([max(1, len(x)) for x in ids], pa.int64())], names=["piece", "n", "n_pieces"])

    return run


_PER_DOC = "uid long, doc_id long, n_bytes long, known long, rest array<struct<piece:string,n:long>>"
_REST = pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())]))


def _per_document(path: str, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, uid = _model(path), head.value, row_uid()
        get = known.get
        for batch in slices(batches):
            sizes, sums, rests = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                if _whole(text):
                    sums.append(len(model.encode(text)))
                    rests.append([])
                    continue
                total, rest = 0, []
                for piece, n in Counter(pre_tokens(text)).items() if text else ():
                    m = get(piece)
                    if m is None:
                        rest.append({"piece": piece, "n": n})
                    else:
                        total += n * m
                sums.append(total)
                rests.append(rest)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + n), pa.int64()), batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rests, _REST)], names=["uid", "doc_id", "n_bytes", "known", "rest"])
            uid += n

    return run


def _least_frequency(vocabulary: DataFrame, head: int) -> int:
    """The frequency from which on there are at most head pieces, from counts by eighths of a power of two (some hundred rows, whatever the vocabulary)."""
    eighth = F.floor(8 * F.log2("n"))
    bins = vocabulary.groupBy(eighth.alias("bin")).agg(F.count("*").alias("pieces"), F.min("n").alias("least"), F.max("n").alias("most")).collect()
    least, rest = max((b["most"] for b in bins), default=0) + 1, head
    for b in sorted(bins, key=lambda b: -b["bin"]):
        rest -= b["pieces"]
        if rest < 0:
            break
        least = b["least"]
    return least


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    spark, path = docs.sparkSession, tokenizer_path(model)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    freq = texts.select("text").mapInArrow(lean(_frequencies), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    vocabulary = save(freq.mapInArrow(lean(_piece_counter(path)), "piece string, n long, n_pieces long"), "piece-counts")
    short = vocabulary.where(F.length("piece") <= HEAD_CHARS)
    top = short.where(F.col("n") >= _least_frequency(short, head)).select("piece", "n_pieces").toArrow()  # at most head rows
    sent = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))
    per_doc = save(texts.mapInArrow(lean(_per_document(path, sent)), _PER_DOC), "piece-frequencies")
    rest = (
        per_doc.select("uid", F.explode("rest").alias("r"))
        .select("uid", "r.piece", "r.n")
        .join(vocabulary.select("piece", "n_pieces"), "piece")
        .groupBy("uid")
        .agg(F.sum(F.col("n") * F.col("n_pieces")).alias("more"))
    )
    total = F.col("known") + F.coalesce(F.col("more"), F.lit(0))
    return per_doc.drop("rest").join(rest, "uid", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
