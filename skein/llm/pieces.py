"""Splitting oversized items at natural boundaries, with an overlap.

The legal ends of a piece are its natural boundaries, in four ranks: before a
top-level definition, heading or after a blank line; at line ends; after white
space; after punctuation. Every boundary is joined to its farthest legal
successor: the farthest boundary of the best rank in the second half of what a
piece may add, else the farthest of any rank, else a hard cut. The successor
table is squared (pointer doubling) until every greedy cut is derived; no cut
waits for the one before it.

Null texts and texts within the limit have no pieces. Repeated (id, text) rows
give one set of pieces; one id with several texts gives one set for each text.
Extra columns are ignored; null ids are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6000, 200
_STRONG = re.compile(r"\n[ \t\r]*\n(?=[^\n])|\n(?=(?:#{1,6} |@|#\[|(?:pub(?:\([a-z]+\))? |export |default |async |public |private |protected |static |abstract |final )*(?:def|class|fn|func|function|impl|struct|enum|trait|interface|type|const|module|package)\b))")
_PUNCTUATION = re.compile(r"[;,.:!?)\]}>。、；，]")


def boundaries(text: str) -> list[np.ndarray]:
    """Ends of pieces by rank, best first: sorted offsets in characters."""
    strong = [m.end() for m in _STRONG.finditer(text)]
    lines = [m.end() for m in re.finditer(r"\n", text)]
    spaces = [m.end() for m in re.finditer(r"[^\S\n]+(?=\S)", text)]
    marks = [m.end() for m in _PUNCTUATION.finditer(text)]
    return [np.asarray(x, dtype=np.int64) for x in (strong, lines, spaces, marks)]


def _hard_cut(text: str, at: int) -> int:
    """``at`` or a little before, so that no character is parted from its marks and no CR from its LF."""
    for k in range(at, max(at - 16, 0), -1):
        c = text[k]
        if not ("̀" <= c <= "ͯ" or c in "‍️" or "\U0001f3fb" <= c <= "\U0001f3ff" or text[k - 1] == "‍" or (c == "\n" and text[k - 1] == "\r")):
            return k
    return at


def successors(points: np.ndarray, ranks: list[np.ndarray], text: str, step: int) -> np.ndarray:
    """For each end of a piece the end of the next: the farthest legal one within ``step``."""
    far = points + step
    out = np.full(len(points), -1, dtype=np.int64)
    for least in (points + max(step // 2, 1), points + 1):
        for ends in ranks:
            if not len(ends):
                continue
            k = np.searchsorted(ends, far, side="right") - 1
            best = np.where(k >= 0, ends[np.maximum(k, 0)], -1)
            out = np.where((out < 0) & (best >= least), best, out)
    n = len(text)
    for i in np.flatnonzero(out < 0):
        out[i] = min(int(far[i]), n) if far[i] >= n else max(_hard_cut(text, int(far[i])), int(points[i]) + 1)
    return np.where(far >= n, n, out)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece; consecutive pieces share ``overlap`` characters."""
    n, step = len(text), limit - overlap
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    if n <= limit:
        return [(0, n)] if n else []
    ranks = boundaries(text)
    # the first piece has no overlap: it ends as if a piece had ended at ``overlap``
    points = np.unique(np.concatenate([np.asarray([overlap, n]), *ranks]))
    points = points[points >= overlap]
    while True:
        nxt = successors(points, ranks, text, step)
        missing = np.setdiff1d(nxt, points)
        if not len(missing):
            break
        points = np.union1d(points, missing)
    jump = np.searchsorted(points, nxt)
    reached = np.zeros(len(points), dtype=bool)
    reached[np.searchsorted(points, overlap)] = True
    while True:
        # after k rounds ``jump`` leads 2^k cuts ahead and ``reached`` holds the first 2^k cuts
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all():
            break
        reached, jump = more, jump[jump]
    ends = points[reached][1:]
    starts = np.concatenate([[0], ends[:-1] - overlap])
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True)]


def split_oversized(df: DataFrame, id_col: str = "id", text_col: str = "body", limit: int = LIMIT, overlap: int = OVERLAP, distinct: bool = True) -> DataFrame:
    """id, piece (from 0), start, end (in characters), text: the pieces of every text longer than ``limit``.

    The pieces of a text without their first ``overlap`` characters (all but
    the first) give the text again. ``distinct=False`` keeps repeated rows.
    """
    big = df.where(F.length(text_col) > limit).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if distinct:
        big = big.dropDuplicates(["id", "text"])
    id_type = big.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = []
                for key, text in zip(batch["id"].iloc[at : at + 64], batch["text"].iloc[at : at + 64], strict=True):
                    rows += [(key, k, a, b, text[a:b]) for k, (a, b) in enumerate(cuts(text, limit, overlap))]
                yield pd.DataFrame(rows, columns=["id", "piece", "start", "end", "text"])

    return big.mapInPandas(cut, f"id {id_type}, piece int, start bigint, end bigint, text string")


def found(nodes: DataFrame) -> DataFrame:
    """id: the nodes that are split."""
    return split_oversized(nodes, distinct=False).select("id").distinct()
