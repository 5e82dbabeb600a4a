"""Problem 7: cut oversized items into balanced pieces at natural boundaries, with a fixed overlap.

Balanced targets: the least number of pieces is computed, equal-length targets are placed, each target snaps to the
strongest boundary near it, and a piece is added whenever a limit fails.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archiveloom.session import ship

#: Boundaries from strong to weak; a cut falls at the end of a match.
BOUNDARIES = [
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n+"),
    re.compile(r"[.!?…]+[\"'»”)\]]*\s+"),
    re.compile(r"[;:,]\s+"),
    re.compile(r"\s+"),
]
PIECES = "item_key bigint, piece_no int, n_pieces int, start_pos int, end_pos int, piece string"


def _uncut(text: str, at: int) -> int:
    """Moves a cut off a combining mark, a joiner or a CR-LF pair, a few characters back at most."""
    for back in range(8):
        p = at - back
        if p <= 0:
            break
        if not (unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍" or text[p - 1 : p + 1] == "\r\n"):
            return p
    return at


def _snap(text: str, target: int, low: int, high: int) -> int:
    """End of the strongest boundary within [low, high]; of equally strong ones the nearest to the target."""
    for kind in BOUNDARIES:
        best = None
        for m in kind.finditer(text, max(0, low - 1), min(len(text), high + 8)):
            if low <= m.end() <= high and (best is None or abs(m.end() - target) < abs(best - target)):
                best = m.end()
        if best is not None:
            return best
    return _uncut(text, target)


def balanced_cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces of one text: each at most ``limit`` code points, each but the first starting ``overlap`` before
    the end of the one before. A text within the limit is one span; an empty text has none."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    size = len(text)
    if size <= limit:
        return [(0, size)] if size else []
    least = -(-(size - overlap) // (limit - overlap))
    for n in range(least, 2 * least + 4):
        for part in (4, 2, 1):  # how far a cut may move from its target, as a part of a piece
            if cuts := _balanced(text, limit, overlap, n, part):
                return [(a - overlap if a else 0, b) for a, b in zip(cuts, [*cuts[1:], size])]
    # an overlap near the limit leaves little choice: each piece in turn ends at the strongest boundary that its limit allows
    spans, start = [], 0
    while size - start > limit:
        end = _snap(text, start + limit, start + overlap + 1, start + limit)
        spans.append((start, end if start + overlap < end <= start + limit else start + limit))
        start = spans[-1][1] - overlap
    return [*spans, (start, size)]


def _balanced(text: str, limit: int, overlap: int, n: int, part: int) -> list[int] | None:
    """Where the ``n`` pieces begin, overlaps aside: equal-length targets, each snapped to the strongest boundary near it. None where a limit fails."""
    size = len(text)
    length = (size + (n - 1) * overlap) / n
    reach = int((length - overlap) / part)
    cuts = [0]
    for i in range(1, n):
        target = round(length + (i - 1) * (length - overlap))
        floor = cuts[-1] + (overlap if i > 1 else 0) + 1
        low, high = max(floor, target - reach), min(size - 1, target + reach, cuts[-1] + limit - (overlap if i > 1 else 0))
        cut = _snap(text, min(max(target, low), high), low, high) if low <= high else 0
        if not low <= cut <= high:
            return None
        cuts.append(cut)
    return cuts if size - cuts[-1] + overlap <= limit else None


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 2048, overlap: int = 20) -> DataFrame:
    """Rows (item_key, piece_no, n_pieces, start_pos, end_pos, piece) for every item.

    Items within the limit pass as one piece on the JVM; only longer ones visit Python, a row at a time, so no task
    holds more than its Arrow batch. Null and empty texts have no pieces; equal keys are cut separately; other columns
    are ignored. Positions are code points, end exclusive.
    """
    ship(df.sparkSession)
    items = df.select(F.col(key).cast("bigint").alias("item_key"), F.col(text).alias("piece"))
    size: Column = F.length("piece")
    short = items.where((size > 0) & (size <= limit)).select(
        "item_key", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_pos"), size.alias("end_pos"), "piece"
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["item_key"], pdf["piece"]):
                spans = balanced_cuts(t, limit, overlap)
                out += [(k, i, len(spans), a, b, t[a:b]) for i, (a, b) in enumerate(spans)]
            yield pd.DataFrame(out, columns=["item_key", "piece_no", "n_pieces", "start_pos", "end_pos", "piece"]).astype({"item_key": "Int64"})

    return short.unionByName(items.where(size > limit).mapInPandas(cut, PIECES))
