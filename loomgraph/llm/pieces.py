"""Splitting oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

import bisect
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from strongest to weakest. A cut falls at the end of a match.
MARKUP = [re.compile(p, re.M) for p in (
    r"(?:\r\n|\n|\r)(?=#{1,6}\s)", r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+", r"(?:\r\n|\n|\r)(?=\s*(?:[-*+]|\d+[.)])\s)",
    r"\r\n|\n|\r(?!\n)", r"[.!?:;][\"')\]]*\s+", r"\s+",
)]
SOURCE = [re.compile(p, re.M) for p in (
    r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+(?=\S)", r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+",
    r"[};]?[ \t]*(?:\r\n|\n|\r(?!\n))(?=\S)", r"[};][ \t]*(?:\r\n|\n|\r(?!\n))", r"\r\n|\n|\r(?!\n)", r"[;}]", r",\s*", r"\s+",
)]
LINE_END = re.compile(r"\r\n|\n|\r")


def _whole(text: str, at: int) -> int:
    """``at`` or the next place before it that parts neither a line end nor a letter from its marks."""
    while at > 0 and ((text[at - 1] == "\r" and text[at : at + 1] == "\n") or (at < len(text) and unicodedata.combining(text[at]))):
        at -= 1
    return at


def cut_points(text: str, limit: int, kind: str | None) -> list[int]:
    """Where to cut ``text`` so that no part is longer than ``limit``: at the strongest boundary in the middle
    half of a part, the one nearest to its midpoint, and again in the halves that are still too long."""
    levels = MARKUP if kind == "section" else SOURCE
    cuts, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        n = hi - lo
        if n <= limit:
            continue
        mid, at = (lo + hi) / 2, 0
        a, b = lo + max(1, n // 4), hi - max(1, n // 4)
        for level in levels:
            ends = [m.end() for m in level.finditer(text, a, b) if lo < m.end() < hi and m.end() == _whole(text, m.end())]
            if ends:
                at = min(ends, key=lambda e: (abs(e - mid), e))
                break
        if not at:
            at = _whole(text, (lo + hi) // 2)
            if at <= lo:  # a letter with marks longer than the half
                at = (lo + hi) // 2
        cuts.append(at)
        todo += [(lo, at), (at, hi)]
    return sorted(cuts)


def split_text(text: str, limit: int, overlap: int, kind: str | None, first_line: int = 1) -> list[tuple[int, int, str, int, int]]:
    """Pieces ``(start, overlap, text, first line, last line)`` of ``text``; each but the first begins with the
    last ``overlap`` characters before it. Without the overlaps the pieces give back the text."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    edges = [0, *cut_points(text, limit - overlap, kind), len(text)]
    ends = [m.end() for m in LINE_END.finditer(text)]
    out, line, k = [], 0, 0
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        back = min(overlap, lo)
        start = lo - back
        moved = _whole(text, start) if start else 0
        if start - moved and hi - moved <= limit:
            start = moved
        a = bisect.bisect_right(ends, start)
        b = bisect.bisect_right(ends, max(start, hi - 1))
        out.append((start, lo - start, text[start:hi], first_line + a, first_line + b))
    return out


PIECE_SCHEMA = (
    "key long, kind string, piece_no int, n_pieces int, piece string, overlap int, start_line int, end_line int"
)


def split_oversized(items: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """Pieces of the items ``(key, text, kind, start_line)`` with more than ``limit`` characters.

    A text is cut at the strongest boundary near its midpoint, then its halves again, until every part
    leaves room for the overlap; sections (``kind`` 'section') break at headings, paragraphs, list items,
    lines and sentences, everything else at blank lines, unindented lines, statement ends and lines. A text
    without any break is cut in the middle. Line numbers count from ``start_line``, from 1 where it is null
    or below 1. Equal keys count once; null, empty and short texts have no pieces.
    """
    long_ones = items.where(F.length("text") > limit).select("key", "text", "kind", "start_line").dropDuplicates(["key"])

    def run(batches):
        for batch in batches:
            rows = []
            for key, text, kind, line in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                parts = split_text(text, limit, overlap, kind, line if line and line > 0 else 1)
                rows += [(key, kind, i + 1, len(parts), p[2], p[1], p[3], p[4]) for i, p in enumerate(parts)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["key", "kind", "piece_no", "n_pieces", "piece", "overlap", "start_line", "end_line"],
            )

    return long_ones.mapInArrow(run, PIECE_SCHEMA)
