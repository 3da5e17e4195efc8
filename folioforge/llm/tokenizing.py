"""Exact, cached encoding of whole texts with a byte-level BPE of the tokenizers library.

A byte-level BPE never merges across pre-tokens, and a space that is followed by
a character that is no white space always begins a pre-token. Texts are therefore
cut at those spaces, and a batch's distinct chunks, where they are words and ASCII
punctuation, into pieces of one pre-token: words, marks, single line ends. The
library encodes a piece once, for as long as the worker's table keeps it. Cutting,
the dictionaries of a batch and look-ups in the table run in Arrow's compiled
kernels, so Python handles new pieces only.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that does not begin a chunk: before white space (a superset of what any engine calls so) or at the end.
_ODD_SPACE = re.compile(r" (?:[\s\x1c-\x1f\x85᠎​﻿]|\Z)")
_CHUNK_SPACE = re.compile(r" (?=[^\s\x1c-\x1f\x85᠎​﻿])")
#: Chunks of these characters are split here; every engine classes them alike. Others go through the library's own splitter.
_PLAIN = re.compile(r"[ \n!-~À-ÖØ-öø-ſ]*")
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ſ", r"!-/:-@\[-`{-~"
#: The usual chunk, in Arrow's syntax: lines of one word and perhaps ASCII punctuation, or of punctuation, one line end between them.
_USUAL = rf"\A ?(?:[{_LETTERS}]+[{_MARKS}]*|[{_MARKS}]+)(?:\n(?:[{_LETTERS}]+[{_MARKS}]*|[{_MARKS}]+))*\z"
_LETTER_LIST, _MARK_LIST = ("".join(c for c in map(chr, range(0x180)) if re.match(f"[{group}]", c)) for group in (_LETTERS, _MARKS))
_NONE, _SPACE, _TURN = (pa.scalar(c, pa.large_string()) for c in ("", " ", "\n"))
_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ſ]+|\s+(?!\S)|\s+")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, or name itself where that is a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> list[str]:
    """The visible stand-in of every byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the rest for code points from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ChunkEncoder:
    """Ids of pieces by way of a growing table: piece -> row of a ragged id array."""

    def __init__(self, path: str, most: int = 400_000):
        os_parallel_off()
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        self.simple = type(self.model).__name__ == "BPE" and self.tokenizer.normalizer is None
        # a usual chunk has no letter right behind its punctuation, so it can't hold such special tokens
        self.usual = self.simple and all(re.search(rf"[{_MARKS}][A-Za-z]", a) for a in self.added)
        self.shown = dict(enumerate(_byte_alphabet()))
        self.words: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.rows = pa.array([], pa.large_string())  # the piece of each row
        self.seen = np.zeros(0, np.int32)  # in how many batches each row was wanted
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _word(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]

    def _piece(self, piece: str) -> list[int]:
        ids = self.words.get(piece)
        if ids is None:
            ids = self._word(piece)
            if len(piece) <= 9 and len(self.words) < 150_000:
                self.words[piece] = ids
        return ids

    def _encode(self, chunk: str) -> list[int]:
        if not self.simple or not _PLAIN.fullmatch(chunk) or any(a in chunk for a in self.added):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return [i for piece in _PRE_TOKENS.findall(chunk) for i in self._piece(piece)]

    def _add(self, pieces: pa.Array, encode: Callable[[str], list[int]]) -> None:
        """New rows, of distinct pieces that the table doesn't have."""
        flat, lengths = array("I"), array("q")
        for piece in pieces.to_numpy(zero_copy_only=False):
            ids = encode(piece)
            flat.extend(ids)
            lengths.append(len(ids))
        new = np.array(lengths, np.int64)
        self.rows = pa.concat_arrays([self.rows, pieces])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(new) - new])
        self.lengths = np.concatenate([self.lengths, new])
        self.flat = np.concatenate([self.flat, np.array(flat, np.uint32)])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int32)])

    def _renew(self) -> None:
        """A table of the pieces that came in several batches, of the commonest half of a full table at most; most pieces come once."""
        least = max(2, int(np.partition(self.seen, -(self.most // 2))[-(self.most // 2)]) + 1)
        kept = self.seen >= least
        self.flat = self.flat[np.repeat(kept, self.lengths)]
        self.rows, self.lengths = self.rows.filter(pa.array(kept)), self.lengths[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.seen = self.seen[kept] // 2  # what was common long ago makes room

    def _rows(self, words: pa.Array, others: pa.Array) -> np.ndarray:
        """Rows of distinct words, which are one pre-token each, and of distinct other chunks; new ones are added."""
        wanted = pa.concat_arrays([words, others])
        rows = pc.index_in(wanted, value_set=self.rows)
        if rows.null_count:
            new = pc.is_null(rows)
            new_words = words.filter(new.slice(0, len(words)))
            new_others = others.filter(new.slice(len(words)))
            had = len(self.rows)
            self._add(new_words, self._word)
            self._add(new_others.filter(pc.invert(pc.is_in(new_others, value_set=new_words))), self._encode)
            added = pc.index_in(wanted.filter(new), value_set=self.rows.slice(had))
            rows = rows.to_numpy(zero_copy_only=False)
            rows[new.to_numpy(zero_copy_only=False)] = added.to_numpy() + had
        rows = np.asarray(rows).astype(np.int64)
        self.seen[rows] += 1
        return rows

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch's distinct chunks end to end, and the number of ids of each."""
        usual = pc.match_substring_regex(chunks, _USUAL) if self.usual else pa.array(np.zeros(len(chunks), bool))
        by_line = pc.split_pattern(chunks.filter(usual), "\n")
        lines, n_lines = by_line.flatten(), pc.list_value_length(by_line).to_numpy().astype(np.int64)
        body = pc.ascii_rtrim(lines, " " + _MARK_LIST)
        bare = pc.equal(pc.binary_length(body), 0)  # punctuation alone, one piece with the space before it
        mark = pc.if_else(bare, _NONE, pc.utf8_ltrim(lines, " " + _LETTER_LIST))
        turn = np.ones(len(lines), bool)
        turn[np.cumsum(n_lines) - n_lines] = False
        coded = pa.concat_arrays([pc.if_else(pa.array(turn), _TURN, _NONE), pc.if_else(bare, lines, body), mark]).dictionary_encode()
        usual = usual.to_numpy(zero_copy_only=False)
        rows = self._rows(coded.dictionary, chunks.filter(pa.array(~usual)))
        n_words = len(coded.dictionary)
        n_pieces = np.ones(len(chunks), np.int64)
        n_pieces[usual] = 3 * n_lines
        owner = np.repeat(usual, n_pieces)
        pieces = np.empty(len(owner), np.int64)
        pieces[owner] = rows[:n_words][coded.indices.to_numpy().reshape(3, -1).T.ravel()]
        pieces[~owner] = rows[n_words:]
        ends = np.concatenate([[0], np.cumsum(self.lengths[pieces])])
        stops = np.cumsum(n_pieces)
        return ragged(self.flat, self.starts, self.lengths, pieces), ends[stops] - ends[stops - n_pieces]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch end to end, and the number of ids of each text."""
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.rows) > self.most:
            self._renew()
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        words = lists.flatten()
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        coded = words.dictionary_encode()
        if any(_ODD_SPACE.search(" " + c) for c in pc.utf8_slice_codeunits(coded.dictionary, 0, 1).unique().to_pylist()):
            plain = texts.to_pylist()
            if any(map(_ODD_SPACE.search, plain)):  # few texts hold runs of spaces; cut those by hand
                parts = [_CHUNK_SPACE.split(t) for t in plain]
                counts = np.fromiter(map(len, parts), np.int64, len(parts))
                words = pa.array([p for ps in parts for p in ps], pa.large_string())
                coded = words.dictionary_encode()
        firsts = np.cumsum(counts) - counts
        heads = words.take(pa.array(firsts)).dictionary_encode()  # the first chunk has no space before it
        flat, lengths = self._chunks(pa.concat_arrays([pc.binary_join_element_wise(_NONE, coded.dictionary, _SPACE), heads.dictionary]))
        rows = coded.indices.to_numpy().astype(np.int64)
        rows[firsts] = len(coded.dictionary) + heads.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths[rows])])
        return ragged(flat, np.cumsum(lengths) - lengths, lengths, rows), ends[firsts + counts] - ends[firsts]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of rows of a ragged array end to end."""
    n = lengths[rows]
    at = np.repeat(starts[rows] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return flat[at]


def os_parallel_off() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary; it outlives tasks."""
    return ChunkEncoder(path)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append end_id to every text's ids."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    stops = np.cumsum(counts + 1) - 1
    keep = np.ones(len(out), bool)
    keep[stops] = False
    out[keep] = ids
    return out, counts + 1
