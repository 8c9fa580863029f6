"""Jaro-Winkler similarity, and an exact similarity join on it."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro(a: str, b: str) -> float:
    """Jaro similarity: letters that match within half the longer length, less half of those out of order."""
    if a == b:
        return 1.0 if a else 0.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    used = [False] * m
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    k = len(mine)
    if not k:
        return 0.0
    moved = sum(x != y for x, y in zip(mine, (b[j] for j in range(m) if used[j]))) // 2
    return (k / n + k / m + (k - moved) / k) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for up to four equal first letters if it's above 0.7."""
    s = jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return s + 0.1 * same * (1 - s) if s > 0.7 else s


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null if either is null."""
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


#: Longest names that are compared many at once, and pairs compared at once.
MANY_CHARS, MANY_PAIRS = 48, 4_000
#: Lengths are put into classes of this ratio; a candidate key names the classes of both partners.
CLASS_RATIO = 1.15
#: Letters besides the common first ones that a key names, by how many those are.
KEY_LETTERS = (3, 2, 2, 1, 1)
#: From rare to frequent; other characters are rarer. The order only steers cost.
_ORDER = {c: i for i, c in enumerate("zqxjkvwybpgfmudchlrnitosea ", 1)}


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler`` of many pairs of names that aren't empty, letter by letter for all pairs at once; long names one by one."""
    out = np.zeros(len(a))
    short = np.array([max(len(x), len(y)) <= MANY_CHARS for x, y in zip(a, b)], bool)
    for i in np.flatnonzero(~short):
        out[i] = jaro_winkler(a[i], b[i])
    index = np.flatnonzero(short)
    for part in (index[k : k + MANY_PAIRS] for k in range(0, len(index), MANY_PAIRS)):
        out[part] = _compared([a[i] for i in part], [b[i] for i in part])
    return out


def _codes(names: list[str], wide: int, pad: int) -> np.ndarray:
    flat = np.frombuffer("".join(names).encode("utf-32-le"), np.int32)
    n = np.array([len(x) for x in names])
    out = np.full((len(names), wide), pad, np.int32)
    out[np.arange(wide) < n[:, None]] = flat
    return out


def _compared(a: list[str], b: list[str]) -> np.ndarray:
    n, m = (np.array([len(x) for x in side]) for side in (a, b))
    x, y = _codes(a, int(n.max()), -1), _codes(b, int(m.max()), -2)
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)[:, None]
    places = np.arange(y.shape[1])
    used, mine = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        free = (y == x[:, i : i + 1]) & ~used & (np.abs(places - i) <= reach)
        hit = free.any(axis=1)
        used[hit, free.argmax(axis=1)[hit]] = True
        mine[:, i] = hit
    k = mine.sum(axis=1)
    most = max(1, int(k.max(initial=0)))
    first = lambda codes, marks: np.take_along_axis(codes, np.argsort(~marks, axis=1, kind="stable"), axis=1)[:, :most]
    moved = ((first(x, mine) != first(y, used)) & (np.arange(most) < k[:, None])).sum(axis=1) // 2
    some = np.maximum(k, 1)
    s = np.where(k > 0, (k / n + k / m + (k - moved) / some) / 3, 0.0)
    same = np.cumprod(x[:, :4][:, : min(4, y.shape[1])] == y[:, :4][:, : min(4, x.shape[1])], axis=1).sum(axis=1)
    return np.where(s > 0.7, s + 0.1 * same * (1 - s), s)


def _matches(n: int, m: int, p: int, threshold: float) -> int:
    """Letters that names of these lengths with ``p`` equal first letters must have in common; more than either has if they can't be similar enough.

    (k/n + k/m + 1) / 3 must reach the Jaro similarity that p equal first letters raise to the threshold."""
    least = (threshold - 0.1 * p) / (1 - 0.1 * p)
    return math.ceil((3 * least - 1) / (1 / n + 1 / m) - 1e-9)


def _class(n: int) -> int:
    return int(math.log(n) / math.log(CLASS_RATIO) + 1e-9)


def _lengths(c: int) -> range:
    low, high = (math.ceil(CLASS_RATIO**k - 1e-6) for k in (c, c + 1))
    return range(max(1, low - 1), high + 2)


@lru_cache(maxsize=100_000)
def _partners(c: int, p: int, threshold: float) -> tuple[tuple[int, int], ...]:
    """(class, letters of the key) of the lengths that names of length class ``c`` may be similar to."""
    out = []
    mine = [n for n in _lengths(c) if _class(n) == c]
    for d in range(max(0, c - 8), c + 9):
        theirs = [m for m in _lengths(d) if _class(m) == d]
        needs = [k for n in mine for m in theirs if (k := _matches(n, m, p, threshold)) <= min(n, m)]
        if needs:
            out.append((d, max(0, min(KEY_LETTERS[p], min(needs) - p))))
    return tuple(out)


@lru_cache(maxsize=100_000)
def _needed(n: int, d: int, p: int, threshold: float) -> int | None:
    """The fewest common letters of a name of length ``n`` with any of length class ``d``; None if it can't be similar to any."""
    needs = [k for m in _lengths(d) if _class(m) == d and (k := _matches(n, m, p, threshold)) <= min(n, m)]
    return min(needs, default=None)


def keys_of(name: str, threshold: float) -> Iterator[tuple[int, int, str]]:
    """(own class, partner's class, key) such that similar names have a key in common, mine with theirs the classes turned round.

    Names whose first p letters (4 at most) are equal must share enough of the other letters, numbered where they repeat; so among the rarest of them, as many as may be unshared and a few more, those few are shared."""
    n, c = len(name), _class(len(name))
    for p in range(min(4, n) + 1):
        seen: Counter = Counter()
        letters = []
        for x in name[p:]:
            seen[x] += 1
            letters.append((-seen[x], _ORDER.get(x, 0), x))
        letters.sort()
        for d, few in _partners(c, p, threshold):
            need = _needed(n, d, p, threshold)
            if need is None:
                continue
            rare = letters[: max(0, n - need + few)]
            for some in combinations(rare, few):
                yield c, d, f"{p}{name[:p]}\0" + "".join(f"{-k}{x}" for k, _, x in some)


def similar_pairs(names: DataFrame, name: str, threshold: float = 0.9, others: DataFrame | None = None) -> DataFrame:
    """a, b and score (0 to 100) of the distinct names whose Jaro-Winkler similarity reaches the threshold (0.9 at least), exact: a < b among the names,
    or, with ``others`` (a column of the same name), a among the names and b, different from a, among the others.

    A name sends keys (see ``keys_of``): its first letters, the lengths' classes and a few of its rarer other letters. Names that share a key are candidates; they are compared many at once. Null and empty names have no partners.
    """
    if threshold < 0.9:
        raise ValueError("the candidate keys need a threshold of 0.9 or more")
    found = candidates(names, name, threshold, others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = jaro_winkler_many(b.column(0).to_pylist(), b.column(1).to_pylist())
            keep = pa.array(np.flatnonzero(s + 1e-12 >= threshold))
            yield pa.record_batch([b.column(0).take(keep), b.column(1).take(keep), pa.array(s * 100).take(keep)], ["a", "b", "score"])

    return found.mapInArrow(run, "a string, b string, score double")


def candidates(names: DataFrame, name: str, threshold: float, others: DataFrame | None = None) -> DataFrame:
    """a and b: the pairs that ``similar_pairs`` compares."""

    def listed(df: DataFrame) -> DataFrame:
        return df.where(F.col(name).isNotNull() & (F.col(name) != "")).select(F.col(name).alias("name")).distinct()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            rows, mine, theirs, keys = [], [], [], []
            for i, x in enumerate(b.column(0).to_pylist()):
                for c, d, key in keys_of(x, threshold):
                    rows.append(i)
                    mine.append(c)
                    theirs.append(d)
                    keys.append(xxhash.xxh3_64_intdigest(key) - (1 << 63))
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), pa.array(mine, pa.int32()), pa.array(theirs, pa.int32()), pa.array(keys, pa.int64())], ["name", "mine", "theirs", "key"])

    sent = lambda df: listed(df).mapInArrow(send, "name string, mine int, theirs int, key long")
    left = sent(names)
    right = left if others is None else sent(others)
    if others is None:  # each pair once: the shorter class first
        left, right = left.where("mine <= theirs"), right.where("theirs <= mine")
    x = left.select(F.col("name").alias("a"), F.col("mine").alias("ca"), F.col("theirs").alias("cb"), "key")
    y = right.select(F.col("name").alias("b"), F.col("theirs").alias("ca"), F.col("mine").alias("cb"), "key")
    met = x.join(y, ["key", "ca", "cb"])
    if others is not None:
        return met.where("a <> b").select("a", "b").distinct()
    met = met.where((F.col("a") < F.col("b")) | (F.col("ca") != F.col("cb")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
