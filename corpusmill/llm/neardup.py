"""Near-duplicate join on word n-gram sets (Jaccard), exact but for hashes, by set-relation skipping.

1. ``_level_table`` counts n-grams of all texts in a sketch whose size follows the input; its
   logarithm orders the n-grams from rare to frequent. The order only steers
   cost: any global order gives the same result.
2. Each distinct text sends the rare part of its set (the prefix that every
   partner must touch) to hash partitions, with its size, the positions of its
   n-grams and a 256-bit parity sketch of the whole set. Entries travel packed, many in a row.
3. A partition holds inverted lists, sorted by set size and cut into blocks. A
   prober reads only the sizes its own position allows, skips a block whose
   best position can't reach the needed overlap, and drops entries whose
   parity sketch proves too large a difference. All three tests are exact.
4. Candidates are verified on the whole sets. Within a group of linked sets,
   the overlaps of a set are derived from those of a highly similar set that was
   already answered, from the n-grams in which the two differ.

Copies of a text are one set throughout; links are between distinct texts. Texts are told apart by
128 bits of hash (``set_id``), n-grams of a text by 64 when links are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import shingles
from corpusmill.session import materialize

#: Counters of the frequency sketch, as powers of two: at least, at most (64 MB as broadcast, 256 MB while a task counts), and characters of text for each between.
LEAST_BITS, MOST_BITS, COUNTER_CHARS = 21, 26, 400
#: Counters in a row of the partial sketches, and partial sketches for each core at most.
SKETCH_BLOCK, SKETCH_TASKS = 1 << 15, 4
#: N-grams of the input for each hash partition.
PART_GRAMS = 2_000_000
#: Entries of an inverted list in a block.
BLOCK = 16
#: A list that the sketch says is longer is split over pairs of parts of about this length.
HOT_LIST = 50_000
#: Pairs of a group, and partners of one set, that are verified in one place; more are split.
GROUP_PAIRS = 5_000
#: Copies of a text that are paired in one place; more are split into blocks.
COPY_BLOCK = 2_048
#: A set is derived from an answered one that is at least so similar.
DERIVE_FROM = 0.8
#: Bytes of candidate ids up to which they're broadcast to the scan; beyond, the join is shuffled.
BROADCAST_BYTES = 64 << 20
#: Texts per numpy batch, and copies remembered by a task.
BATCH, SEEN = 2_000, 500_000
#: N-grams that wait to be counted, and steps of a level for a doubling of the count.
HELD_GRAMS, LEVELS = 4_000_000, 5


@dataclass(frozen=True)
class Rule:
    """When two sets are linked: texts of ``min_words`` words whose distinct runs of ``n`` words have a Jaccard similarity of ``threshold``."""

    n: int = 5
    threshold: float = 0.8
    min_words: int = 5

    def need(self, both):
        """The overlap that sets of together ``both`` n-grams must have."""
        t = self.threshold / (1 + self.threshold)
        return np.ceil(np.asarray(both) * t - 1e-9).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts, ``BATCH`` at a time, each text that this task saw lately left out."""
    seen: set[int] = set()
    ids: list[int] = []
    texts: list[str] = []
    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i in seen:
                continue
            if len(seen) > SEEN:
                seen.clear()
            seen.add(i)
            ids.append(i)
            texts.append(x)
            if len(ids) >= BATCH:
                yield ids, texts
                ids, texts = [], []
    if ids:
        yield ids, texts


def _narrow(x: np.ndarray) -> np.ndarray:
    """The counts in as few bytes each as they need."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 256 else np.uint16 if most < 65_536 else np.uint32)


def _count_sketch(rule: Rule, bits: int):
    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        shift = np.uint64(64 - bits)
        held: list[np.ndarray] = []

        def add():
            places, n = np.unique(np.concatenate(held), return_counts=True)
            counts[places] += n.astype(np.uint32)
            held.clear()

        for _, texts in _texts(batches):
            held.append((shingles.batch(texts, rule.n, rule.min_words)[1] >> shift).astype(np.int64))
            if sum(map(len, held)) > HELD_GRAMS:
                add()
        if held:
            add()
        for k in range(0, len(counts), SKETCH_BLOCK):
            part = counts[k : k + SKETCH_BLOCK]
            if part.any():
                part = _narrow(part)
                yield pa.record_batch([pa.array([k // SKETCH_BLOCK], pa.int32()), pa.array([part.itemsize], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "width", "counts"])

    return run


def _add_blocks(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, width, raw in zip(*(c.to_pylist() for c in b.columns)):
            part = np.frombuffer(raw, f"u{width}").astype(np.int64)
            total[block] = total[block] + part if block in total else part
    for block, part in total.items():
        level = np.minimum(255, np.round(LEVELS * np.log2(part + 1))).astype(np.uint8)
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "levels"])


def _level_table(sets: DataFrame, rule: Rule) -> np.ndarray:
    """log2 of the count of each hash bucket, in fifths, in one byte a bucket.

    Buckets grow with the text up to 2 ** MOST_BITS. Partial sketches are as many as a few for each core, however many files there are, and each
    block of buckets is added up on its own; so the merge is spread wider the larger the sketch."""
    chars = sets.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, chars / COUNTER_CHARS)))))
    tasks = SKETCH_TASKS * sets.sparkSession.sparkContext.defaultParallelism
    rows = (
        sets.coalesce(tasks)
        .mapInArrow(_count_sketch(rule, bits), "block int, width int, counts binary")
        .repartition("block")
        .mapInArrow(_add_blocks, "block int, levels binary")
        .toLocalIterator()
    )
    levels = np.zeros(1 << bits, np.uint8)
    for r in rows:
        levels[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] = np.frombuffer(bytes(r.levels), np.uint8)
    return levels


def _bits_of(levels: np.ndarray) -> np.uint64:
    return np.uint64(64 - (len(levels).bit_length() - 1))


def _keys(doc: np.ndarray, h: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets as keys that sort from rare to frequent: the level, then 56 bits of the hash."""
    level = levels[(h >> _bits_of(levels)).astype(np.int64)].astype(np.uint64)
    # the low 56 bits of h are kept: the level depends on h alone, so equal n-grams have equal keys
    return shingles.distinct(doc, (level << np.uint64(56)) | (h & np.uint64((1 << 56) - 1)))


def _hash_keys(k: np.ndarray, salt) -> np.ndarray:
    return shingles._mix(k + np.uint64(0x9E3779B97F4A7C15) * salt.astype(np.uint64))


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones and so on: high bytes are mostly zeros, which compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(raw: memoryview, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def packed(sid: np.ndarray, size: np.ndarray, sketch: np.ndarray, counts: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> bytes:
    """Entries of one partition: set ids, sizes, sketches and how many keys each has; then 32 bits of each key and its position.

    A partition's keys differ in other bits too seldom to matter: equal ones only add candidates. Positions above 16 bits are sent as the greatest, which only admits more."""
    return b"".join([sid.astype("<i8").tobytes(), _planes(size.astype("<u4")), sketch.tobytes(), _planes(counts.astype("<u4")), (keys >> np.uint64(32)).astype("<u4").tobytes(), _planes(np.minimum(pos, 65_535).astype("<u2"))])


def unpacked(n: int, k: int, body: bytes) -> tuple[np.ndarray, ...]:
    """What ``packed`` was given: n entries with k keys."""
    view, at = memoryview(body), np.cumsum([0, 8 * n, 4 * n, 32 * n, 4 * n, 4 * k, 2 * k])
    part = [view[a:b] for a, b in zip(at, at[1:])]
    return np.frombuffer(part[0], "<i8"), _from_planes(part[1], "<u4"), np.frombuffer(part[2], np.uint8).reshape(n, 32), _from_planes(part[3], "<u4"), np.frombuffer(part[4], "<u4"), _from_planes(part[5], "<u2")


def _prefixes(rule: Rule, levels, parts: int):
    """Rows (part, entries, keys, packed entries) of the distinct texts, a row a part for each batch of texts."""

    def run(batches):
        table = levels.value
        for ids, texts in _texts(batches):
            doc, key = _keys(*shingles.batch(texts, rule.n, rule.min_words), table)
            if not len(doc):
                continue
            begin = shingles.starts(doc)
            size = np.diff(np.r_[begin, len(doc)])
            at = np.repeat(np.arange(len(begin)), size)
            pos = np.arange(len(doc)) - begin[at]
            bits = np.bincount(at * 256 + (key & np.uint64(255)).astype(np.int64), minlength=256 * len(begin)) & 1
            sketch = np.packbits(bits.astype(np.uint8).reshape(-1, 256), axis=1)
            sid = np.array(ids, np.int64)[doc[begin]]
            # the overlap with any partner is at least need(size + threshold * size)
            keep = pos < (size - np.ceil(rule.threshold * size - 1e-9).astype(np.int64) + 1)[at]
            at, pos, key = at[keep], pos[keep], key[keep]
            splits = np.ceil(np.exp2((key >> np.uint64(56)).astype(np.float64) / LEVELS) / HOT_LIST).astype(np.int64)
            if (splits > 1).any():  # a hot list: one copy of the entry for each pair of parts that its own part is in
                splits = np.maximum(1, splits)
                rep = np.repeat(np.arange(len(key)), splits)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(splits) - splits, splits)
                mine = (sid[at[rep]].astype(np.uint64) % splits[rep].astype(np.uint64)).astype(np.int64)
                salt = np.where(splits[rep] > 1, np.minimum(mine, other) * 65_537 + np.maximum(mine, other) + 1, 0)
                at, pos, key = at[rep], pos[rep], key[rep]
            else:
                salt = np.zeros(len(key), np.int64)
            hashed = _hash_keys(key, salt)
            part = (hashed % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((pos, at, part))
            at, pos, hashed, part = at[order], pos[order], hashed[order], part[order]
            entry = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])])
            ends = np.r_[entry, len(at)]
            of_part = np.flatnonzero(np.r_[True, part[entry][1:] != part[entry][:-1]])
            rows = []
            for a, b in zip(of_part, np.r_[of_part[1:], len(entry)]):
                i, j, who = ends[a], ends[b], at[entry[a:b]]
                rows.append((int(part[i]), int(b - a), int(j - i), packed(sid[who], size[who], sketch[who], np.diff(ends[a : b + 1]), hashed[i:j], pos[i:j])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["part", "entries", "keys", "body"])

    return run


def _expand(lo: np.ndarray, hi: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, position) for every position in [lo, hi) of each row, at most about ``most`` at once."""
    n = np.maximum(0, hi - lo)
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        m = n[a:b]
        row = np.repeat(np.arange(a, b), m)
        yield row, np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + lo[row]
        a = b


def candidates_of(rule: Rule, sid, size, sketch, keys, owner, pos):
    """Pairs of set indexes whose lists, positions, sizes and sketches allow the overlap.

    ``owner`` has the set of each key, ``pos`` its position in that set."""
    t = rule.threshold
    n = size[owner]
    # longest partner that an entry at this position can serve, as the smaller of the two
    reach = np.floor((n - pos) * (1 + t) / t - n + 1e-9).astype(np.int64)
    index = np.flatnonzero(reach >= n)
    index = index[np.lexsort((pos[index], n[index], keys[index]))]
    ikey, isize, ireach, iowner = keys[index], n[index], reach[index], owner[index]
    if not len(index):
        return np.zeros((0, 2), np.int64)
    runs = np.flatnonzero(np.r_[True, ikey[1:] != ikey[:-1]])
    run_key, run_end = ikey[runs], np.r_[runs[1:], len(ikey)]
    # probers, in the role of the larger set: the sizes that their own position allows
    least = np.ceil(n * t - 1e-9).astype(np.int64)
    most = np.minimum(n, np.floor((n - pos) * (1 + t) / t - n + 1e-9).astype(np.int64))
    run = np.searchsorted(run_key, keys)
    run = np.where((run < len(run_key)) & (run_key[np.minimum(run, len(run_key) - 1)] == keys), run, -1)
    probe = np.flatnonzero((run >= 0) & (most >= least))
    begin = runs[run[probe]]
    probe = probe[(run_end[run[probe]] - begin > 1) | (iowner[begin] != owner[probe])]  # lists with another set's entry
    if not len(probe):
        return np.zeros((0, 2), np.int64)
    # (list, size) is one increasing number, so one search finds every range
    wide = np.int64(int(n.max()) + 2)
    line = np.repeat(np.arange(len(runs)), run_end - runs) * wide + isize
    lo = np.searchsorted(line, run[probe] * wide + least[probe], "left")
    hi = np.searchsorted(line, run[probe] * wide + most[probe], "right")
    best = np.maximum.reduceat(ireach, np.arange(0, len(ireach), BLOCK))
    words = sketch.view(np.uint64).reshape(len(sid), 4)
    found = []
    for row, block in _expand(lo // BLOCK, np.where(hi > lo, (hi - 1) // BLOCK + 1, 0)):
        p = probe[row]
        live = best[block] >= n[p]
        row, block, p = row[live], block[live], p[live]
        for r, entry in _expand(np.maximum(lo[row], block * BLOCK), np.minimum(hi[row], (block + 1) * BLOCK)):
            q = p[r]
            ok = ireach[entry] >= n[q]
            a, b = iowner[entry[ok]], owner[q[ok]]
            ok = (a != b) & ((size[a] < size[b]) | (sid[a] < sid[b]))
            a, b = a[ok], b[ok]
            both = size[a] + size[b]
            ok = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= both - 2 * rule.need(both)
            found.append(np.unique(a[ok] * np.int64(len(sid)) + b[ok]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return np.stack([pairs // len(sid), pairs % len(sid)], axis=1)


def _candidates(rule: Rule):
    """Pairs of set ids of one partition's lists; copies that came from several tasks count once. A partition is held whole: its size is bounded by ``PART_GRAMS``."""

    def lists(bodies: list[tuple[int, int, bytes]]):
        sid, size, sketch, counts, keys, pos = map(np.concatenate, zip(*(unpacked(*b) for b in bodies)))
        bodies.clear()
        owner = np.repeat(np.arange(len(sid)), counts)
        first = np.zeros(len(sid), bool)
        first[np.unique(sid, return_index=True)[1]] = True
        if not first.all():
            keep, number = first[owner], np.cumsum(first) - 1
            sid, size, sketch, owner, keys, pos = sid[first], size[first], sketch[first], number[owner[keep]], keys[keep], pos[keep]
        pairs = candidates_of(rule, sid, size.astype(np.int64), np.ascontiguousarray(sketch), keys, owner, pos.astype(np.int64))
        a, b = sid[pairs[:, 0]], sid[pairs[:, 1]]
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        held: dict[int, list] = {}  # one partition, as rows are partitioned by it
        for batch in batches:
            for part, n, k, body in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(part, []).append((n, k, body))
        for bodies in held.values():
            yield lists(bodies)

    return run


def _sets(rule: Rule):
    """(set id, keys) of every distinct text."""

    def run(batches):
        for ids, texts in _texts(batches):
            doc, key = shingles.distinct(*shingles.batch(texts, rule.n, rule.min_words))
            begin = shingles.starts(doc)
            ends = np.r_[begin[1:], len(doc)]
            yield pa.record_batch(
                [pa.array([ids[doc[a]] for a in begin], pa.int64()), pa.array([key[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary())], ["sid", "keys"]
            )

    return run


def verified(rule: Rule, pairs: list[tuple[int, int]], sets: dict[int, frozenset], tally: dict[str, int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """The linked pairs of one group, with overlap and sizes.

    A set with an answered, highly similar set takes over that set's overlaps and
    corrects them by the n-grams in which the two differ; else they're counted. ``tally`` gets how many were derived and how many counted."""
    partners: dict[int, list[int]] = {}
    for a, b in pairs:
        partners.setdefault(a, []).append(b)
        partners.setdefault(b, []).append(a)
    answers: dict[int, dict[int, int]] = {}
    out = []
    for x in sorted(partners):
        own, leader, known = sets[x], None, answers.setdefault(x, {})
        for y, overlap in known.items():
            if overlap >= DERIVE_FROM * (len(own) + len(sets[y]) - overlap):
                leader = y
                break
        if leader is not None:
            more, less = own - sets[leader], sets[leader] - own
        for y in partners[x]:
            if y in known:
                continue
            other = sets[y]
            base = answers[leader].get(y) if leader is not None else None
            if tally is not None:
                how = "counted" if base is None else "derived"
                tally[how] = tally.get(how, 0) + 1
            if base is None:
                overlap = len(own & other)
            else:
                overlap = base + sum(k in other for k in more) - sum(k in other for k in less)
            known[y] = answers.setdefault(y, {})[x] = overlap
            if overlap >= rule.need(len(own) + len(other)):
                out.append((x, y, overlap, len(own), len(other)) if x < y else (y, x, overlap, len(other), len(own)))
    return out


def _verify(rule: Rule):
    names = ["a", "b", "overlap", "size_a", "size_b"]

    def close(pairs, sets):
        found = verified(rule, pairs, sets)
        return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in range(5)], names)

    def run(batches):
        group, pairs, sets = None, [], {}
        for batch in batches:
            for label, salt, kind, a, b, keys in zip(*(c.to_pylist() for c in batch.columns)):
                if (label, salt) != group:
                    if pairs:
                        yield close(pairs, sets)
                    group, pairs, sets = (label, salt), [], {}
                if kind == 0:
                    sets[a] = frozenset(np.frombuffer(keys, np.uint64).tolist())
                else:
                    pairs.append((a, b))
        if pairs:
            yield close(pairs, sets)

    return run


def _hash(text) -> Column:
    return F.xxhash64(text)


def set_id(df: DataFrame, text: str) -> Column:
    """The id of a row's text: equal for equal texts, different for different ones.

    64 bits of hash, and for texts that share them with a different text (told by 64 more bits, over all rows) another 64. Such clashes
    are a handful even among ten billion texts; only they are collected.
    """
    first, second = _hash(F.col(text)), F.xxhash64(F.lit("second"), F.col(text))
    rows = df.where(F.col(text).isNotNull()).groupBy(first.alias("sid")).agg(F.min(second).alias("low"), F.max(second).alias("high"))
    clashes = [r.sid for r in rows.where("low <> high").select("sid").toLocalIterator()]
    return F.when(first.isin(clashes), second).otherwise(first) if clashes else first


def _texts_of(df: DataFrame, text: str, sid: Column, *keep: Column) -> DataFrame:
    """(sid, text, kept columns) of the rows that have a text."""
    return df.where(F.col(text).isNotNull()).select(sid.alias("sid"), F.col(text).alias("text"), *keep)


def links(df: DataFrame, text: str, rule: Rule = Rule(), sid: Column | None = None) -> DataFrame:
    """Links between distinct texts: a, b (set ids, a < b), overlap, size_a, size_b.

    Null texts, and texts of fewer than ``min_words`` words, have no links. Copies are one set and aren't linked to themselves; ``members`` has their rows. An
    empty table has no links. Other columns aren't read, so clashing names do no harm. The text of each set is read whole.
    """
    spark = df.sparkSession
    sets = _texts_of(df, text, set_id(df, text) if sid is None else sid)
    levels = _level_table(sets, rule)
    shared = spark.sparkContext.broadcast(levels)
    # partitions hold about as many n-grams each at any size of input
    grams = float(np.exp2(levels[levels > 0] / LEVELS).sum())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, math.ceil(grams / PART_GRAMS))
    prefixes = sets.mapInArrow(_prefixes(rule, shared, parts), "part int, entries int, keys int, body binary")
    found = prefixes.repartitionById(parts, "part").mapInArrow(_candidates(rule), "a long, b long").distinct()
    pairs = materialize(found, "p1-candidates")
    grouped = materialize(_grouped(pairs), "p1-groups")

    wanted = grouped.select("label", "salt", F.explode(F.array("a", "b")).alias("sid")).distinct()
    ids = wanted.select("sid").distinct()
    if math.prod((grouped.count(), 2, 8)) <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    keys = sets.join(ids, "sid", "left_semi").mapInArrow(_sets(rule), "sid long, keys binary").groupBy("sid").agg(F.first("keys").alias("keys"))
    rows = wanted.join(keys, "sid").select("label", "salt", F.lit(0).alias("kind"), F.col("sid").alias("a"), F.col("sid").alias("b"), "keys")
    rows = rows.unionByName(grouped.select("label", "salt", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("keys")))
    return (
        rows.repartition(parts, "label", "salt")
        .sortWithinPartitions("label", "salt", "kind")
        .mapInArrow(_verify(rule), "a long, b long, overlap long, size_a long, size_b long")
    )


def _grouped(pairs: DataFrame) -> DataFrame:
    """label, salt, a, b: candidates by the smallest set near them, so that similar sets come together.

    A group of more than ``GROUP_PAIRS`` pairs is a grid of cells, by the hashes of both sets; the pairs of a set with more partners than that are also
    spread by the hash of the partner. So no cell holds many more, and a set is sent to few cells."""
    ends = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
    label = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count("*").alias("partners"))
    both = pairs.join(label.select("a", F.col("label").alias("la"), F.col("partners").alias("pa")), "a").join(label.select(F.col("a").alias("b"), F.col("label").alias("lb"), F.col("partners").alias("pb")), "b")
    both = both.select(F.least("la", "lb").alias("label"), "a", "b", "pa", "pb")
    large = both.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_PAIRS).select("label", F.ceil(F.sqrt(F.col("n") / GROUP_PAIRS)).alias("cuts"))
    cuts = F.coalesce("cuts", F.lit(1))
    cell = F.pmod(F.xxhash64("a"), cuts) * cuts + F.pmod(F.xxhash64("b"), cuts)
    hub = F.greatest("pa", "pb")
    spread = F.when(hub > GROUP_PAIRS, F.pmod(F.xxhash64(F.when(F.col("pa") >= F.col("pb"), F.col("b")).otherwise(F.col("a")), F.lit("hub")), F.ceil(hub / GROUP_PAIRS))).otherwise(0)
    return both.join(large, "label", "left").select("label", (cell + cuts * cuts * spread).alias("salt"), "a", "b")


def members(df: DataFrame, text: str, key: str, sid: Column | None = None) -> DataFrame:
    """(sid, key) of every row that has a text."""
    return _texts_of(df, text, set_id(df, text) if sid is None else sid, F.col(key).alias("key")).select("sid", "key")


def _enough_words(rule: Rule):
    return F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}]+")) >= rule.min_words


def _blocks() -> Column:
    """All blocks of a text's copies."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("cuts", F.lit(1)) - 1))


def pairs(df: DataFrame, text: str, key: str, rule: Rule = Rule()) -> DataFrame:
    """Every pair of rows (key_a < key_b) that are near copies: the links of their texts
    expanded by the members of both, and the pairs of copies of a text of enough words.

    The number of rows is that of the pairs; ``classes`` has one row per text instead. The copies of a text are cut into blocks of ``COPY_BLOCK``, and blocks are joined, so a hot text is spread. A row
    counts once even if its key repeats with the same text.
    """
    sid = set_id(df, text)
    found = materialize(links(df, text, rule, sid).select("a", "b"), "p1-links")
    rows = members(df, text, key, sid)
    several = rows.groupBy("sid").agg(F.count("*").alias("copies")).where("copies > 1").select("sid", F.ceil(F.col("copies") / COPY_BLOCK).alias("cuts"))
    several = materialize(several, "p1-several")
    hot = several.where("cuts > 1")  # at most a row for COPY_BLOCK rows of the input
    rows = rows.join(hot, "sid", "left").select("sid", "key", F.pmod(F.xxhash64("key"), F.coalesce("cuts", F.lit(1))).alias("block"))
    ends = found
    for side in "ab":
        ends = ends.join(hot.withColumnRenamed("sid", side), side, "left").select(*ends.columns, _blocks().alias(f"block_{side}"))
    a, b = (rows.select(F.col("sid").alias(s), F.col("block").alias(f"block_{s}"), F.col("key").alias(k)) for s, k in (("a", "x"), ("b", "y")))
    unlike = ends.join(a, ["a", "block_a"]).join(b, ["b", "block_b"]).select("x", "y")
    copies = _texts_of(df, text, sid, F.col(key).alias("key")).where(_enough_words(rule)).select("sid", "key").join(several, "sid")
    copies = materialize(copies.select("sid", "key", "cuts", F.pmod(F.xxhash64("key"), F.col("cuts")).alias("block")), "p1-copies")
    x = copies.select("sid", F.col("key").alias("x"), F.col("block").alias("p"), _blocks().alias("q"))
    y = copies.select("sid", F.col("key").alias("y"), F.col("block").alias("q"), _blocks().alias("p"))
    equal = x.join(y, ["sid", "p", "q"]).where("x < y").select("x", "y")
    return unlike.unionByName(equal).where("x <> y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def classes(df: DataFrame, text: str, key: str, rule: Rule = Rule()) -> DataFrame:
    """One row per row with a text: key, class_key (the smallest key of the rows with that text),
    copies (rows with that text) and links (near copies of it among the other texts)."""
    sid = set_id(df, text)
    found = links(df, text, rule, sid)
    degree = found.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("links"))
    rows = members(df, text, key, sid)
    reps = rows.groupBy("sid").agg(F.min("key").alias("class_key"), F.count("*").alias("copies"))
    reps = reps.join(degree, "sid", "left").select("sid", "class_key", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return rows.join(reps, "sid").select("key", "class_key", "copies", "links")
