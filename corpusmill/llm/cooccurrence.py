"""Items that share a record more often than chance.

Pair counts are exact. Chance is a bipartite configuration model: item i and record r are
joined with probability x_i y_r / (1 + x_i y_r), fitted so that every item's
frequency and every record's size are met on average. The number of common records of two items is then
Poisson-binomial; its upper tail is a p-value, and a false-discovery rate follows from
the counts of p-values over all pairs of items.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize

#: Items of a record that are paired in one row; larger records are cut into blocks and spread.
BLOCK = 256
#: Item frequencies and record sizes above are binned to about this relative width, which bounds what the fit collects.
EXACT, WIDTH = 2_000, 0.002
#: Most steps of the fit, how near it must come, and cells of its matrix that are held at once.
STEPS, CLOSE, FIT_CELLS = 20_000, 1e-6, 4_000_000
#: Bins of log10 p for the false-discovery rate.
BINS = 4_000
#: What ``least_surprise`` allows for: binned frequencies (relative), and the saddlepoint's error (in log10 p).
BINNED, SADDLE = 0.01, 0.3
#: Bits of the filter of items that are frequent enough, for each of them, and most bits in all (16 MB).
FILTER_BITS, MOST_BITS = 10, 1 << 27
#: Tasks that fill partial filters.
FILTER_TASKS = 64
#: Rows of item statistics up to which they're broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000


def baskets(df: DataFrame, columns: list[str], sets_of) -> DataFrame:
    """(field, items) of every row and column: ``sets_of(column, value)`` gives the set of items, which is sorted by code point. Empty sets are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields, items = [], []
            for k, name in enumerate(columns):
                for value in b.column(k).to_pylist():
                    found = sets_of(name, value)
                    if found:
                        fields.append(name)
                        items.append(sorted(found))
            yield pa.record_batch([pa.array(fields, pa.string()), pa.array(items, pa.list_(pa.string()))], ["field", "items"])

    return df.select(*columns).mapInArrow(run, "field string, items array<string>")


def pair_counts(sets: DataFrame) -> DataFrame:
    """(field, a, b, shared) with a < b: records that have both items. Partial counts are made before the shuffle."""
    size = F.size("items")
    at = F.posexplode("items").alias("__i", "a")
    small = sets.where((size > 1) & (size <= BLOCK)).select("field", "items", at)
    small = small.select("field", "a", F.explode(F.slice("items", F.col("__i") + 2, F.greatest(F.size("items"), F.lit(1)))).alias("b"))
    cuts = F.sequence(F.lit(0), F.ceil(size / BLOCK).cast("int") - 1)
    block = lambda k: F.slice("items", k * BLOCK + 1, BLOCK)
    large = sets.where(size > BLOCK).select("field", "items", F.explode(cuts).alias("p"))
    large = large.select("field", "items", "p", F.explode(F.sequence(F.col("p"), F.ceil(size / BLOCK).cast("int") - 1)).alias("q"))
    large = large.select("field", block(F.col("p")).alias("x"), block(F.col("q")).alias("y")).repartition("field", "x", "y")
    large = large.select("field", "y", F.explode("x").alias("a")).select("field", "a", F.explode("y").alias("b")).where("a < b")
    return small.unionByName(large).groupBy("field", "a", "b").agg(F.count("*").alias("shared"))


def _bin(c):
    """Whole numbers, binned above ``EXACT`` to a relative width."""
    wide = F.round(F.exp(F.round(F.log(c) / WIDTH) * WIDTH)).cast("long")
    return F.when(c <= EXACT, c.cast("long")).otherwise(wide)


def _met(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over j of weight[j] * p and of weight[j] * p * (1 - p), p = x[i] * y[j] / (1 + x[i] * y[j]), some rows at a time, so that no whole matrix is held."""
    rows = max(1, FIT_CELLS // max(1, len(y)))
    first, second = np.zeros(len(x)), np.zeros(len(x))
    for k in range(0, len(x), rows):
        p = np.outer(x[k : k + rows], y)
        p /= 1 + p
        first[k : k + rows] = p @ weight
        second[k : k + rows] = (p * (1 - p)) @ weight
    return first, second


def fit(counts: np.ndarray, items: np.ndarray, sizes: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x of each item frequency and y of each record size: ``items[k]`` items have ``counts[k]``, ``records[k]`` records have ``sizes[k]``; both give the same total.

    Newton steps on the logarithms, x and y in turn, go on until every expected frequency and size is met to ``CLOSE`` of it; if that takes over ``STEPS`` steps
    an error is raised: an unfinished fit is never used. Items of every record, and records of every item, have p = 1."""
    total = max(1.0, float((counts * items).sum()))
    x, y = counts / math.sqrt(total), sizes / math.sqrt(total)

    def step(x, y, weight, wanted):
        whole = wanted >= weight.sum() * (1 - 1e-12)
        first, second = _met(x, y, weight)
        off = np.where(whole, 0.0, first / wanted - 1)
        move = np.clip((wanted - first) / np.maximum(second, 1e-300), -1, 1)
        return np.where(whole, 1e12, np.clip(x * np.exp(move), 1e-15, 1e12)), float(np.abs(off).max(initial=0))

    off = math.inf
    for _ in range(STEPS):
        x, off_x = step(x, y, records, counts)
        y, off_y = step(y, x, items, sizes)
        off = max(off_x, off_y)
        if off < CLOSE:
            return x, y
    raise RuntimeError(f"the null model isn't fitted after {STEPS} steps: a frequency or a size is off by {off:.2g} of it")


def log10_tail(k: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 P(X >= k) of sums of n[j] trials with chances p[i, j], one sum a row.

    Lugannani and Rice's saddlepoint formula with Daniels' correction for whole numbers; where k isn't above the mean, the normal tail."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    p = np.clip(p, 1e-300, 1 - 1e-12)
    mean, var = (p * n).sum(1), (p * (1 - p) * n).sum(1)
    t = np.log(np.maximum(k, 1e-9) / np.maximum(mean, 1e-300))
    most = n.sum()
    kk = np.minimum(k, most - 1e-6)
    for _ in range(60):
        q = p * np.exp(t)[:, None]
        q = q / (1 - p + q)
        step = ((q * n).sum(1) - kk) / np.maximum((q * (1 - q) * n).sum(1), 1e-300)
        t = t - np.clip(step, -1, 1)
        if np.abs(step).max(initial=0) < 1e-10:
            break
    q = p * np.exp(t)[:, None]
    cumulant = (n * np.log1p(-p + q)).sum(1)
    q = q / (1 - p + q)
    second = np.maximum((q * (1 - q) * n).sum(1), 1e-300)
    w2 = np.maximum(2 * (t * kk - cumulant), 0)
    w = np.sqrt(w2)
    u = (1 - np.exp(-np.abs(t))) * np.sqrt(second)
    # upper tail by its logarithm: the density term times a bracket that stays near one
    mills = _mills(w)
    log = -w2 / 2 - 0.5 * math.log(2 * math.pi) + np.log(np.maximum(mills + 1 / np.maximum(u, 1e-300) - 1 / np.maximum(w, 1e-300), 1e-300))
    normal = np.log(np.maximum(_upper((k - 0.5 - mean) / np.sqrt(np.maximum(var, 1e-300))), 1e-300))
    out = np.where((k > mean + 1e-9) & (w > 1e-3), log, normal)
    return np.where(k <= 0, 0.0, np.minimum(out, 0) / math.log(10))


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v) for v in x])


def _upper(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(z / math.sqrt(2))


def _mills(w: np.ndarray) -> np.ndarray:
    """(1 - Phi(w)) / phi(w) for w >= 0."""
    near = np.minimum(w, 25)
    small = _upper(near) / (np.exp(-near * near / 2) / math.sqrt(2 * math.pi))
    far = np.maximum(w, 25)
    return np.where(w <= 25, small, 1 / far - 1 / far**3 + 3 / far**5)


def _bits(fields: list[str], items: list[str], size: int) -> np.ndarray:
    """Two places of each item in a filter of ``size`` bits (a power of two)."""
    h = np.array([xxhash.xxh3_64_intdigest(f"{f}\0{i}") for f, i in zip(fields, items)], np.uint64)
    return np.stack([h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)]).astype(np.int64)


def _testable(singles: DataFrame, records: dict[str, int], min_shared: int, min_lift: float) -> DataFrame:
    """The items whose frequency lets them be in a pair of ``min_shared`` records and ``min_lift``."""
    most = F.create_map(*(F.lit(v) for f, n in records.items() for v in (f, n / min_lift if min_lift else math.inf)))
    return singles.where((F.col("n") >= min_shared) & (F.col("n") <= most[F.col("field")]))


def possible(sets: DataFrame, singles: DataFrame, records: dict[str, int], min_shared: int, min_lift: float) -> DataFrame:
    """The sets without items that can't be in a pair of ``min_shared`` records and ``min_lift``; no pair is lost.

    Neither item of such a pair is in fewer than ``min_shared`` records, nor, as shared <= the smaller count, in more than records / min_lift. The kept items go into a filter of fixed
    size (two hash bits each): a false hit only keeps an item that could go.
    """
    kept = _testable(singles, records, min_shared, min_lift)
    size = 1 << min(MOST_BITS.bit_length() - 1, max(10, math.ceil(math.log2(1 + FILTER_BITS * kept.count()))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            bits[_bits(b.column(0).to_pylist(), b.column(1).to_pylist(), size).ravel()] = True
        if bits.any():
            yield pa.record_batch([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    table = np.zeros(size // 8, np.uint8)
    for r in kept.select("field", "item").coalesce(FILTER_TASKS).mapInArrow(fill, "bits binary").toLocalIterator():
        table |= np.frombuffer(bytes(r.bits), np.uint8)
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            lists = b.column(1)
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            fields = np.repeat(np.array(b.column(0).to_pylist(), object), sizes).tolist()
            ok = known[_bits(fields, flat.to_pylist(), size)].all(axis=0)
            offsets = np.r_[0, np.cumsum(ok)][np.r_[0, np.cumsum(sizes)]].astype(np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(ok)))], ["field", "items"])

    return sets.mapInArrow(keep, "field string, items array<string>")


def surprising_pairs(sets: DataFrame, min_shared: int = 2, min_lift: float = 0.0, tails: bool = True) -> DataFrame:
    """field, item_a < item_b, records (with an item of the field), count_a, count_b, shared,
    expected and log10_p of every pair that shares ``min_shared`` records and at least
    ``min_lift`` times what independence gives. Without ``tails`` the null isn't fitted and the last two are left out.

    ``sets`` has field and items (distinct, sorted). Empty baskets don't count; an empty table gives no rows. Frequencies above ``EXACT`` are met to half of ``WIDTH``, 0.1 %: log10_p is then off by at most about a thousandth of shared.
    """
    sets, singles, records = _statistics(sets)
    models = _models(sets, singles) if tails else {}
    paired = possible(sets, singles, records, min_shared, min_lift) if records and (min_shared > 1 or min_lift) else sets
    counted = _limited(_counted(paired, singles, records), min_shared, min_lift)
    if not tails:
        return counted.select("field", F.col("a").alias("item_a"), F.col("b").alias("item_b"), "records", "count_a", "count_b", "shared")
    return _scored(counted, models)


def cases(sets: DataFrame, min_shared: int, min_lift: float) -> DataFrame:
    """The pairs that share ``min_shared`` records and at least ``min_lift`` times what independence gives, found by the null: columns as of ``surprising_pairs`` and rate.

    The tests are the pairs of items whose frequencies, which the null holds fixed, let them be such a pair. All that share a record are scored and ranked, and those go on that Benjamini and
    Hochberg keep at the rate of ``least_surprise``; the limits, which are exact, are checked last. So no pair within the limits is lost, as it would be at a rate given beforehand.
    The rate is the expected share of false ones among the pairs up to a pair's p, above 1 where chance gives more than were seen. A field whose null can't be fitted is warned of and only checked by the limits.
    """
    sets, singles, records = _statistics(sets)
    models = _models(sets, singles, needed=False)
    tested = _testable(singles, records, min_shared, min_lift) if records else singles
    paired = possible(sets, singles, records, min_shared, min_lift) if records else sets
    scored = _binned(materialize(_scored(_counted(paired, tested, records), models), "p3-tested"))
    m = {r.field: r.n * (r.n - 1) / 2 for r in tested.groupBy("field").agg(F.count("*").alias("n")).collect()}
    rows = []
    for field, found in _rates(scored, m).items():
        last = math.floor(10 * least_surprise(models[field], min_shared, min_lift)) if field in models else 0
        at = max((rate for b, rate in found if b <= last), default=-1.0)
        rows += [(field, b, rate, rate <= at) for b, rate in found]
    rates = scored.sparkSession.createDataFrame(rows, "field string, bin int, rate double, kept boolean")
    kept = scored.join(F.broadcast(rates), ["field", "bin"]).where("kept OR isnan(log10_p)").drop("bin", "kept")  # at most BINS rows a field
    return _limited(kept, min_shared, min_lift)


def least_surprise(model: tuple, min_shared: int, min_lift: float) -> float:
    """A log10 p under the null that every pair of ``min_shared`` records and ``min_lift`` is at or below; 0 if the null bounds nothing.

    The expected number of common records is at most g * count_a * count_b / records, where g is that ratio for two items of the least frequency: the commoner an item, the less it leans
    to large records. With the limits that is at most r * shared, r = g / min_lift, and then, by Chernoff's bound for sums of trials, p <= (r * exp(1 - r)) ** shared if r < 1.
    """
    c, x, y, n = model
    p = 1 / (1 + 1 / (np.interp(min_shared, c, x) * y))
    r = (1 + BINNED) * n.sum() * (n * p * p).sum() / (n * p).sum() ** 2 / max(min_lift, 1e-300)
    return min(0.0, min_shared * (math.log10(r) + (1 - r) / math.log(10)) + SADDLE) if r < 1 else 0.0


def _statistics(sets: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The sets and (field, item, n), both written, and how many sets each field has."""
    sets = materialize(sets, "p3-sets")
    singles = sets.select("field", F.explode("items").alias("item")).groupBy("field", "item").agg(F.count("*").alias("n"))
    singles = materialize(singles, "p3-items")
    return sets, singles, {r.field: r.n for r in sets.groupBy("field").agg(F.count("*").alias("n")).collect()}  # a row a field


def _counted(sets: DataFrame, singles: DataFrame, records: dict[str, int]) -> DataFrame:
    """field, b, a, shared, count_a, count_b, records of the pairs of items in ``singles``."""
    n_of = F.create_map(*(F.lit(v) for kv in records.items() for v in kv)) if records else F.create_map(F.lit(""), F.lit(0))
    small = singles.count() <= BROADCAST_ROWS
    side = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    a = side(singles.select("field", F.col("item").alias("a"), F.col("n").alias("count_a")))
    b = side(singles.select("field", F.col("item").alias("b"), F.col("n").alias("count_b")))
    counted = pair_counts(sets).join(a, ["field", "a"]).join(b, ["field", "b"])
    return counted.withColumn("records", n_of[F.col("field")].cast("long"))


def _limited(counted: DataFrame, min_shared: int, min_lift: float) -> DataFrame:
    """The limits on exact counts."""
    counted = counted.where(F.col("shared") >= min_shared)
    return counted.where(F.col("records").cast("double") * F.col("shared") >= min_lift * F.col("count_a").cast("double") * F.col("count_b")) if min_lift else counted


def _scored(counted: DataFrame, models: dict[str, tuple]) -> DataFrame:
    """With expected and log10_p; of fields without a model they're NaN."""
    shared = counted.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = np.array(batch.column("field").to_pylist(), dtype=object)
            k, ca, cb = (np.array(batch.column(x).to_pylist(), float) for x in ("shared", "count_a", "count_b"))
            expected, tail = np.full(len(k), np.nan), np.full(len(k), np.nan)
            for field in set(fields) & set(shared.value):
                c, x, y, n = shared.value[field]
                own = np.flatnonzero(fields == field)
                for part in np.array_split(own, max(1, len(own) * len(y) // 50_000)):
                    pa_, pb = (1 / (1 + 1 / (np.interp(v[part], c, x)[:, None] * y[None, :])) for v in (ca, cb))
                    expected[part] = (pa_ * pb * n).sum(1)
                    tail[part] = log10_tail(k[part], pa_ * pb, n)
            yield pa.record_batch([*batch.columns, pa.array(expected), pa.array(tail)], [*batch.schema.names, "expected", "log10_p"])

    kinds = "field string, b string, a string, shared long, count_a long, count_b long, records long"
    scored = counted.select("field", "b", "a", "shared", "count_a", "count_b", "records").mapInArrow(run, f"{kinds}, expected double, log10_p double")
    return scored.select("field", F.col("a").alias("item_a"), F.col("b").alias("item_b"), "records", "count_a", "count_b", "shared", "expected", "log10_p")


def _models(sets: DataFrame, singles: DataFrame, needed: bool = True) -> dict[str, tuple]:
    """For each field the frequencies, their x, the record sizes' y and how many records have each. Histograms are collected, of a few thousand bins at any size of input; a bin has the mean of its values, so totals stay. A field that can't be fitted is an error if it's ``needed``, else it's warned of and left out."""
    sizes: dict[str, list] = {}
    for r in sets.groupBy("field", _bin(F.size("items")).alias("size")).agg(F.count("*").alias("rows"), F.avg(F.size("items")).alias("mean")).collect():
        sizes.setdefault(r.field, []).append((r["mean"], r.rows))
    freqs: dict[str, list] = {}
    for r in singles.groupBy("field", _bin(F.col("n")).alias("bin")).agg(F.count("*").alias("items"), F.avg("n").alias("mean")).collect():
        freqs.setdefault(r.field, []).append((r["mean"], r["items"]))
    models = {}
    for name in sorted(sizes):
        c, i = np.array(sorted(freqs[name]), float).T
        s, n = np.array(sorted(sizes[name]), float).T
        try:
            models[name] = (c, *fit(c, i, s, n), n)
        except RuntimeError as e:
            if needed:
                raise
            warnings.warn(f"{name}: {e}")
    return models


def with_false_discovery(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with q, the least false-discovery rate at which each is kept (Benjamini and Hochberg, all pairs of items tested).

    Ranks come from counts of log10 p in ``BINS`` bins a field, so they're exact to a bin's width of 0.1; pairs absent from ``pairs`` count as p = 1."""
    tested = sets.select("field", F.explode("items").alias("item")).distinct().groupBy("field").agg((F.count("*") * (F.count("*") - 1) / 2).alias("m"))
    pairs = _binned(materialize(pairs, "p3-scored"))
    m = {r.field: r.m for r in tested.collect()}
    rows = [(field, b, min(1.0, rate)) for field, found in _rates(pairs, m).items() for b, rate in found]
    rates = pairs.sparkSession.createDataFrame(rows, "field string, bin int, q double")
    return pairs.join(F.broadcast(rates), ["field", "bin"]).drop("bin")  # at most BINS rows a field


def _binned(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("bin", F.greatest(F.floor(F.col("log10_p") * 10), F.lit(-BINS)).cast("int"))


def _rates(pairs: DataFrame, m: dict[str, float]) -> dict[str, list[tuple[int, float]]]:
    """For each field the bins of log10 p with Benjamini and Hochberg's rate of each, not cut at 1, of ``m`` tests."""
    counts: dict[str, list] = {}
    for r in pairs.groupBy("field", "bin").agg(F.count("*").alias("n")).orderBy("bin").collect():
        counts.setdefault(r.field, []).append((r.bin, r.n))
    rates = {}
    for field, found in counts.items():
        bins = np.array([b for b, _ in found])
        rank = np.cumsum([n for _, n in found])
        rate = m[field] * 10.0 ** np.minimum((bins + 1) / 10, 0) / rank
        rates[field] = [(int(b), float(q)) for b, q in zip(bins, np.minimum.accumulate(rate[::-1])[::-1])]
    return rates
