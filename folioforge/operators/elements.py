"""Corpus rows to element documents, image placement, matching of images to paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rng
from ..functions.text import split_parts, zero_pad

_NULL = {"src": "string", "caption": "string", "span_all": "boolean", "text_index": "int"}


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """The driver's documents as corpus rows; ids have six characters at least."""
    rows = documents.select(zero_pad(F.col("doc_id"), 6).alias("id"), "text")
    return rows.select("id", "text", (rng.h("vert", F.col("id")) % 2 == 0).alias("is_vertical"), (1 + rng.h("col", F.col("id")) % 3).cast("int").alias("num_columns"))


def text_element(content: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), content.alias("content"), *[F.lit(None).cast(t).alias(c) for c, t in _NULL.items()])


def to_elements(corpus: DataFrame, delimiter: str = "\n\n", text_col: str = "text") -> DataFrame:
    """Element documents: every part between delimiters is a text element, the title is blank."""
    parts = F.transform(split_parts(F.col(text_col), delimiter), text_element)
    return corpus.select("id", F.lit("").alias("title"), parts.alias("elements"), "is_vertical", F.col("num_columns").alias("column_count"))


def image_slots(elements: DataFrame) -> DataFrame:
    """Sorted insertion points of images: between 0 and half the paragraphs, with replacement."""
    n = F.size("elements")
    count = rng.randint("images", F.col("id"), 0, F.floor(n / 2)).cast("int")
    draws = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: rng.randint("slot", F.concat_ws("/", F.col("id"), k.cast("string")), 0, n.cast("bigint")).cast("int")))
    return elements.withColumn("slots", F.sort_array(F.coalesce(draws, F.array().cast("array<int>"))))


def image_source(doc_id: Column, k: Column) -> Column:
    return F.concat(F.substring(doc_id, 1, 3), F.lit("/"), doc_id, F.lit("_"), zero_pad(k, 3), F.lit(".jpg"))


def place_images(slotted: DataFrame) -> DataFrame:
    """Merge images into the elements by one sort on (slot, kind, ordinal)."""
    field = lambda e: F.struct(*[e[c].alias(c) for c in ("type", "content", *_NULL)])
    texts = F.transform("elements", lambda e, i: F.struct(i.alias("slot"), F.lit(1).alias("kind"), i.alias("ord"), field(e).alias("e")))
    image = lambda k: F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("content"), image_source(F.col("id"), k).alias("src"), F.lit("").alias("caption"), F.lit(None).cast("boolean").alias("span_all"), F.lit(None).cast("int").alias("text_index"))
    images = F.transform("slots", lambda s, k: F.struct(s.alias("slot"), F.lit(0).alias("kind"), k.alias("ord"), image(k).alias("e")))
    merged = F.transform(F.array_sort(F.concat(images, texts)), lambda x: x["e"])
    return slotted.withColumn("elements", merged).drop("slots")


def positions(elements: DataFrame) -> DataFrame:
    """Places of images and texts in the merged elements."""
    indexed = F.transform("elements", lambda e, i: F.struct(e["type"].alias("type"), i.alias("i")))
    of = lambda image: F.transform(F.filter(indexed, lambda x: (x["type"] == "image") if image else (x["type"] == "text")), lambda x: x["i"])
    return elements.select("id", of(True).alias("images"), of(False).alias("texts"))


#: Modulus and factors of the tie-break; SQL repeats them.
PRIME, IMAGE_FACTOR, TEXT_FACTOR = 2147483647, 7919, 104729


def tie_break(seed: int, image, text):
    """A keyed number below 2 ** 31 for an image and a text, by place; arrays give arrays."""
    x = (seed + image * IMAGE_FACTOR + text * TEXT_FACTOR) % PRIME
    return x * x % PRIME


_FAR = 1 << 61


def _after(best: tuple[np.ndarray, np.ndarray], distance: np.ndarray, tie: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Least (distance, tie) of one more image for every prefix of texts, from those without it; sums of ties stay below far.

    The prefix minimum of pairs: ties of equal least distance form stretches, and a
    stretch's least tie is found by a plain minimum once later stretches are put far below earlier ones.
    """
    d, t = best[0][:-1] + distance, best[1][:-1] + tie
    least = np.minimum.accumulate(d)
    base = np.cumsum(np.concatenate([[0], least[1:] < least[:-1]])) * (2 * far)
    ties = np.minimum.accumulate(np.where(d == least, t, far) - base) + base
    return np.concatenate([[_FAR], np.minimum(least, _FAR)]), np.concatenate([[0], ties])


def _costs(images: np.ndarray, texts: np.ndarray, seed: int, backward: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least (distance, tie) of all images over every prefix of texts, or over every suffix."""
    if backward:
        images, texts = images[::-1], texts[::-1]
    best = np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts) + 1, np.int64)
    for image in images:
        best = _after(best, (image - texts) ** 2, tie_break(seed, image, texts) >> (31 - bits), len(images) << bits)
    return (best[0][::-1], best[1][::-1]) if backward else best


def assign(images: list[int], texts: list[int], seed: int = 0) -> list[int]:
    """Texts for images, one to one, at the least sum of squared distances; among those, at the least sum of keyed tie-breaks.

    Both lists rise. Every optimum keeps the order, so a program over prefixes is
    exact. It is solved by halves: the costs of the first images over prefixes and of the last ones over
    suffixes tell where the texts divide, so that memory grows with the texts alone.
    """
    if len(images) > len(texts):
        raise ValueError("more images than texts")
    # whole bits of the tie-break, fewer for documents beyond some thousand million pairs
    bits = max(8, min(31, 60 - len(images).bit_length() - len(texts).bit_length()))
    out, todo = [0] * len(images), [(0, np.asarray(images, np.int64), np.asarray(texts, np.int64))]
    while todo:
        at, own, of = todo.pop()
        if len(own) == 1:
            distance = (own[0] - of) ** 2
            near = np.flatnonzero(distance == distance.min())
            out[at] = int(of[near[np.argmin(tie_break(seed, own[0], of[near]))]])
        elif len(own):
            half = len(own) // 2
            first, last = _costs(own[:half], of, seed, False, bits), _costs(own[half:], of, seed, True, bits)
            distance, tie = first[0] + last[0], first[1] + last[1]
            near = np.flatnonzero(distance == distance.min())
            cut = int(near[np.argmin(tie[near])])
            todo += [(at, own[:half], of[:cut]), (at + half, own[half:], of[cut:])]
    return out


def match_images(placed: DataFrame) -> DataFrame:
    """id, image_index, text_index, distance of every image (squared distance); ties are broken by a key of the document. A document with more images than texts is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, images, texts, seed in zip(batch["id"], batch["images"], batch["texts"], batch["seed"]):
                images = [int(x) for x in images]
                for i, t in zip(images, assign(images, [int(x) for x in texts], int(seed))):
                    rows.append((doc, i, t, float((i - t) ** 2)))
            yield pd.DataFrame(rows, columns=["id", "image_index", "text_index", "distance"])

    keyed = positions(placed).where("size(images) > 0").withColumn("seed", rng.h("tie", F.coalesce("id", F.lit(""))) % PRIME)
    return keyed.mapInPandas(run, "id string, image_index int, text_index int, distance double")


def match_totals(matches: DataFrame) -> DataFrame:
    """id, number of images and sum of their distances."""
    return matches.groupBy("id").agg(F.count("*").alias("n_images"), F.sum("distance").alias("total_distance"))


def match_native(images: Column, texts: Column, seed: Column) -> Column:
    """The same program as nested folds: per image the least (distance, tie, path) for every text prefix; for short arrays."""
    long = lambda v: F.lit(v).cast("bigint")
    state = lambda distance, tie, path: F.struct(distance.alias("distance"), tie.alias("tie"), path.alias("path"))
    nothing = F.array().cast("array<int>")
    start = F.transform(F.concat(F.array(F.lit(-1)), texts), lambda _: state(long(0), long(0), nothing))
    none = state(long(_FAR), long(0), nothing)

    def row(before: Column, image: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            last, old, text = F.element_at(done, -1), F.get(before, j), F.get(texts, j)
            x = (seed + image * long(IMAGE_FACTOR) + text * long(TEXT_FACTOR)) % PRIME
            step = (image - text).cast("bigint")
            better = state(old["distance"] + step * step, old["tie"] + x * x % PRIME, F.array_append(old["path"], text))
            return F.array_append(done, F.least(better, last))

        return F.aggregate(F.sequence(F.lit(0), F.size(texts) - 1), F.array(none), cell)

    return F.element_at(F.aggregate(images, start, row), -1)["path"]


def with_matches(placed: DataFrame, matches: DataFrame) -> DataFrame:
    """Set text_index of the image elements."""
    of = matches.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("image_index", "text_index"))).alias("folio_matches"))
    joined = placed.join(of, "id", "left")
    found = F.transform("elements", lambda e, i: F.when(e["type"] == "image", e.withField("text_index", F.try_element_at(F.col("folio_matches"), i))).otherwise(e))
    return joined.withColumn("elements", found).drop("folio_matches")


def exploded(elements: DataFrame) -> DataFrame:
    """One row per element with its place. The outer form is taken since Spark filters the other by its array, which computes elements twice."""
    rows = elements.select("id", "is_vertical", "column_count", F.posexplode_outer("elements").alias("pos", "e")).where("pos is not null")
    return rows.select("id", "is_vertical", "column_count", "pos", "e.*")
