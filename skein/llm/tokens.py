"""Encoding texts with a public byte-level BPE, without a regex engine.

Pre-tokenisation works on whole arrays: the text's code points are mapped to
classes (letter, number, space, other white space, other). The pattern's
automaton forgets its state at every change of class, so its transition
functions are constant after one step and their scan reduces to comparing
neighbouring classes; white-space runs give up their last character, and
contractions are patched in where an apostrophe starts a slice. The slices feed
a cached pair merging over the rank file. Offsets are kept for decoding.

An empty or null text has the empty list of ids. Special tokens' strings in a
text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import spread

#: Where the rank files lie, and the vocabulary used where no other is named.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Slices kept in a worker's cache before it is emptied.
CACHE = 400_000
LETTER, NUMBER, SPACE, WHITE, OTHER = range(5)
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                table[c] = LETTER
            elif kind == "N":
                table[c] = NUMBER
        # fixed values: the code points of the property White_Space
        table[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
        table[0x20] = SPACE
        _classes = table
    return _classes


def starts(text: str) -> np.ndarray:
    """Offsets (in characters) at which the slices of a text start, and its length at the end."""
    n = len(text)
    if n == 0:
        return np.zeros(1, dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = classes()[points]
    white = (kind == SPACE) | (kind == WHITE)
    group = np.where(white, np.uint8(WHITE), kind)
    cut = np.ones(n, dtype=bool)
    cut[1:] = group[1:] != group[:-1]
    # the last white-space character before a non-space leaves its run, and joins the next slice if it is U+0020
    last = np.zeros(n, dtype=bool)
    last[:-1] = white[:-1] & ~white[1:]
    at = np.flatnonzero(last)
    cut[at] = True
    joined = at[kind[at] == SPACE] + 1
    cut[joined] = False
    # contractions: an apostrophe that starts a slice takes s, t, m, d, re, ve or ll, and ends it
    quotes = np.flatnonzero((points == 39) & cut)
    if len(quotes):
        first = np.zeros(len(quotes), dtype=np.uint32)
        second = np.zeros(len(quotes), dtype=np.uint32)
        has1, has2 = quotes + 1 < n, quotes + 2 < n
        first[has1] = points[quotes[has1] + 1]
        second[has2] = points[quotes[has2] + 2]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        for hit, size in ((one, 2), (two & ~one, 3)):
            where = quotes[hit]
            cut[where + 1] = False
            ends = where + size
            cut[ends[ends < n]] = True
            # what follows keeps its own start: white space that joins the next slice has started already
    return np.append(np.flatnonzero(cut), n)


class Encoder:
    """Byte-pair merging by rank, with a cache of slices."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the pair with the lowest rank (the leftmost of equals) is merged until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = 0
            end[i], right[i] = stop, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if (p := left[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_with_slices(text)[0]

    def encode_with_slices(self, text: str | None) -> tuple[list[int], np.ndarray, list[int]]:
        """Ids, slice offsets in characters, and the number of ids of each slice."""
        if not text:
            return [], np.zeros(1, dtype=np.int64), []
        at = starts(text)
        ids, counts, cache = [], [], self.cache
        bounds = at.tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            piece = text[a:b]
            got = cache.get(piece)
            if got is None:
                got = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[piece] = got
            ids += got
            counts.append(len(got))
        return ids, at, counts

    def decode(self, ids) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


def rank_bytes(tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> bytes:
    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        return f.read()


_encoders: dict[str, Encoder] = {}


def _shared(df: DataFrame, tokenizers: str, vocabulary: str):
    """The rank file (under 1 MB) and the classes of all code points (1.1 MB) for the Python workers."""
    return df.sparkSession.sparkContext.broadcast((rank_bytes(tokenizers, vocabulary), classes()))


def worker_encoder(shared, key: str) -> Encoder:
    """The encoder of this Python worker, made once from the broadcast rank file."""
    global _classes
    if key not in _encoders:
        ranks, _classes = shared.value
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """id and ids of each row, and with ``offsets`` slice_start (characters) and slice_ids (ids of each slice).

    One row out for each row in, repeated or not. The rank file (under 1 MB) and the table of classes are broadcast.
    """
    shared = _shared(df, tokenizers, vocabulary)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, ids array<int>" + ", slice_start array<bigint>, slice_ids array<int>" * offsets

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(shared, vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                done = [encoder.encode_with_slices(t if isinstance(t, str) else None) for t in part["_text"]]
                out = {id_col: part[id_col], "ids": [np.asarray(x[0], dtype=np.int32) for x in done]}
                if offsets:
                    out |= {"slice_start": [x[1][:-1] for x in done], "slice_ids": [np.asarray(x[2], dtype=np.int32) for x in done]}
                yield pd.DataFrame(out)

    return spread(df.select(F.col(id_col), F.col(text_col).alias("_text"))).mapInPandas(run, schema)


def lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """id and tokens: the number of ids of each row."""
    shared = _shared(df, tokenizers, vocabulary)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(shared, vocabulary)
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "tokens": np.asarray([len(encoder.encode(t if isinstance(t, str) else None)) for t in batch["_text"]], dtype=np.int32)})

    return spread(df.select(F.col(id_col), F.col(text_col).alias("_text"))).mapInPandas(run, f"{id_col} {id_type}, tokens int")


def decode(encoded: DataFrame, id_col: str = "doc_id", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """id and text of encoded rows; null ids give a null text."""
    shared = _shared(encoded, tokenizers, vocabulary)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(shared, vocabulary)
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "text": [None if x is None else encoder.decode(x) for x in batch["ids"]]})

    return encoded.select(id_col, "ids").mapInPandas(run, f"{id_col} {id_type}, text string")
