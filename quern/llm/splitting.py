"""Splitting oversized texts at natural boundaries, by recursive bisection."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of boundaries, the strongest first; a text without any is cut between characters.
KINDS = ("block", "line", "sentence", "word", "char")

_LINE = r"(?:\r\n|\n|\r)"
_ENDS = [
    re.compile(rf"{_LINE}(?:[ \t]*{_LINE})+"),
    re.compile(_LINE),
    re.compile(r"(?<=[.!?])\s+"),
    re.compile(r"\s+"),
]


def boundaries(text: str) -> list[list[int]]:
    """For each kind but ``char``, the positions in order at which a text may be cut: after its white space."""
    first, last = len(text) - len(text.lstrip()), len(text.rstrip())
    return [[m.end() for m in p.finditer(text) if m.start() >= first and m.end() <= last] for p in _ENDS]


def _nearest(places: list[int], low: int, high: int, middle: float) -> int | None:
    """The place within (low, high) that is nearest to the middle."""
    a, b = bisect_right(places, low), bisect_left(places, high)
    if a >= b:
        return None
    at = bisect_left(places, middle, a, b)
    near = places[max(a, at - 1) : min(b, at + 1)]
    return min(near, key=lambda p: (abs(p - middle), p))


def bisect_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], int]:
    """Spans ``(start, end, kind of the cut at the end)`` of at most ``limit - overlap`` characters, and the finest cut needed.

    A part that is too long is cut at the strongest kind of boundary inside it, at
    the one nearest to its middle, and both halves again. As a part is only cut at a
    weaker kind once it has no stronger one, the weakest kind by which a part of more
    than ``limit`` characters (outer blanks not counted) was cut tells how fine the
    cutting has to be at least. Neighbours that fit together are joined again, but
    not across a boundary stronger than those at their ends.
    """
    places, done, needed = boundaries(text), [], 0
    parts = [(0, len(text), 0)]
    while parts:
        start, end, kind = parts.pop()
        if end - start <= limit - overlap:
            done.append((start, end, kind))
            continue
        bare = text[start:end]
        blank = len(bare) - len(bare.lstrip())
        low, high = start + blank, start + len(bare.rstrip())
        middle = (low + high) / 2
        for k, own in enumerate(places):
            if (cut := _nearest(own, low, high, middle)) is not None:
                break
        else:
            k, cut = len(places), (start + end) // 2
            while cut > start + 1 and (unicodedata.combining(text[cut]) or text[cut] in "\n‍"):
                cut -= 1
        if high - low > limit:
            needed = max(needed, k)
        parts += [(cut, end, kind), (start, cut, k)]
    return _joined(done, limit - overlap), needed


def _joined(parts: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int, int]]:
    """Neighbouring parts that fit together as one, unless the boundary between them is stronger than one at their ends.

    So a stronger boundary is never passed over while the text is cut at a weaker one beside it.
    """
    out, begins = [parts[0]], 0
    for start, end, kind in parts[1:]:
        before, _, inner = out[-1]
        ends = kind if end < parts[-1][1] else 0
        if end - before <= limit and inner >= max(begins, ends):
            out[-1] = (before, end, kind)
        else:
            out.append((start, end, kind))
            begins = inner
    return out


def overlap_start(text: str, start: int, overlap: int) -> int:
    """Where a piece that starts at ``start`` begins with its overlap: after a blank, at most ``overlap`` back."""
    least = max(0, start - overlap)
    if not least:
        return 0
    found = re.compile(r"\s(?=\S)").search(text, least - 1, start)
    return found.end() if found else least


def split_oversized(df: DataFrame, keys: Sequence[str], text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Numbered pieces of every text: ``keys, piece_no, start, core_start, end, boundary, cut, piece``.

    ``piece`` is the text from ``start`` to ``end`` in code points and has at most
    ``limit``; up to ``core_start`` it repeats the end of the piece before. Without
    the repeated parts the pieces join to the very text. ``boundary`` is the kind of
    boundary at the piece's end ('' for the last), ``cut`` the finest kind needed to
    keep all pieces within the limit, outer blanks not counted ('' where the text is). Texts within the limit
    are one piece, made without leaving the JVM; null and empty texts give none.
    Repeated rows come out repeatedly. Other columns are dropped.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    inner = [f"_k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(i) for k, i in zip(keys, inner)], F.col(text).alias("_text"))
    size = F.char_length("_text")
    extra = "piece_no int, start long, core_start long, end long, boundary string, cut string, piece string"
    schema = T.StructType([*(T.StructField(i, base.schema[i].dataType) for i in inner), *T.StructType.fromDDL(extra)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                body = row[-1]
                spans, needed = bisect_text(body, limit, overlap)
                cut = KINDS[needed]
                for n, (start, end, kind) in enumerate(spans):
                    begin = overlap_start(body, start, overlap) if n else 0
                    out.append((*row[:-1], n + 1, begin, start, end, KINDS[kind] if end < len(body) else "", cut, body[begin:end]))
            yield pd.DataFrame(out, columns=schema.names)

    long = base.where(size > limit).mapInPandas(run, schema)
    zero = F.lit(0).cast("long")
    short = base.where((size <= limit) & (size > 0)).select(
        *inner, F.lit(1).alias("piece_no"), zero.alias("start"), zero.alias("core_start"), size.cast("long").alias("end"), F.lit("").alias("boundary"), F.lit("").alias("cut"), F.col("_text").alias("piece")
    )
    return long.unionByName(short).withColumnsRenamed(dict(zip(inner, keys)))
