"""Cutting oversized texts into overlapping pieces at natural boundaries.

Cuts snap to the strongest boundary of a window: a paragraph break, else the end of a
sentence, else white space, else the window's end. ``balanced`` places equal-length
targets for the least number of pieces and adds pieces until no limit fails;
``longest`` puts each target at the limit, which makes the first pieces as long as allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n"


@dataclass(frozen=True)
class Limits:
    """Characters: most in a piece, least before a cut is sought, overlap of neighbours."""

    most: int = 1200
    least: int = 600
    overlap: int = 150

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.least < self.most:
            raise ValueError("limits need 0 <= overlap < least < most")


def boundary(text: str, low: int, high: int) -> tuple[int, int]:
    """(cut, strength) of the strongest boundary in (low, high], the last of its kind:
    3 after a paragraph break, 2 after a sentence, 1 after white space, 0 the window's end."""
    at = text.rfind("\n\n", max(0, low - 1), high)
    if at >= 0 and at + 2 > low:
        return at + 2, 3
    best = -1
    for end in ".!?":
        for white in WHITE:
            best = max(best, text.rfind(end + white, max(0, low - 1), high))
    if best >= 0 and best + 2 > low:
        return best + 2, 2
    best = max(text.rfind(white, low, high) for white in WHITE)
    return (best + 1, 1) if best >= 0 else (high, 0)


def next_start(text: str, end: int, overlap: int) -> int:
    """The first start of a word in [end - overlap, end), else end - overlap."""
    for p in range(max(1, end - overlap), end):
        if text[p - 1] in WHITE and text[p] not in WHITE:
            return p
    return end - overlap


def longest(text: str, limits: Limits = Limits()) -> list[tuple[int, int]]:
    """Pieces whose targets stand at the limit: each ends at the strongest boundary beyond the least length."""
    out, start = [], 0
    while len(text) - start > limits.most:
        end, _ = boundary(text, start + limits.least, start + limits.most)
        out.append((start, end))
        start = next_start(text, end, limits.overlap)
    return [*out, (start, len(text))]


def balanced(text: str, limits: Limits = Limits()) -> list[tuple[int, int]]:
    """Pieces of nearly equal length: the least number that can hold the text, targets at equal
    distances, each snapped to the strongest boundary near it (the nearest of the strongest);
    one more piece whenever one grows past the limit."""
    n = len(text)
    if n <= limits.most:
        return [(0, n)]
    stride = limits.most - limits.overlap
    count = max(2, math.ceil((n - limits.overlap) / stride))
    while True:
        reach = max(1, min((limits.most - limits.overlap) // 4, n // (3 * count)))
        out, start, ok = [], 0, True
        for k in range(1, count):
            target = (2 * n * k + count) // (2 * count)
            low, high = max(start + limits.overlap, target - reach), min(target + reach, start + limits.most, n)
            if high <= low:
                ok = False
                break
            after, strong = boundary(text, low, high)
            near, also = boundary(text, low, min(high, target)) if target > low else (after, -1)
            end = near if also >= strong and abs(near - target) <= abs(after - target) else after
            out.append((start, end))
            start = next_start(text, end, limits.overlap)
        if ok and n - start <= limits.most:
            return [*out, (start, n)]
        count += 1


def pieces(df: DataFrame, keys: list[str], text: str, limits: Limits = Limits(), place=longest, over_only: bool = True) -> DataFrame:
    """piece_no (from 1), start_pos and end_pos of the pieces of each text, beside its keys.

    Positions are code points of the untrimmed text. Texts up to the limit, empty and null ones among them, give no rows
    (with ``over_only=False`` a text that isn't null gives at least one piece). Repeated rows give repeated pieces. A text is cut alone, in time linear in its length; nothing is shuffled.
    """
    kept = df.select(*keys, F.col(text).alias("__text"))
    kept = kept.where(F.col("__text").isNotNull())
    if over_only:
        kept = kept.where(F.length("__text") > limits.most)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cuts = [], []
            for row, t in enumerate(b.column(len(keys)).to_pylist()):
                found = place(t, limits)
                rows += [row] * len(found)
                cuts += [(i, s, e) for i, (s, e) in enumerate(found, 1)]
            index = pa.array(rows, pa.int64())
            own = [b.column(k).take(index) for k in range(len(keys))]
            yield pa.record_batch([*own, *(pa.array([c[k] for c in cuts], pa.int32()) for k in range(3))], [*keys, "piece_no", "start_pos", "end_pos"])

    return kept.mapInArrow(run, f"{schema}, piece_no int, start_pos int, end_pos int")


def sections(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, section_no (from 0) and text of every section; null or empty arrays have none."""
    return df.select(F.col(key), F.posexplode(column).alias("section_no", "__section")).select(key, "section_no", F.col("__section.text").alias("text"))
