import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import neardup, shingles
from corpusmill.llm.neardup import Rule

RULE = Rule(3, 0.5, 20)


def brute(rows, rule):
    sets = {}
    for k, t in rows:
        w = shingles.WORD.findall(t.lower()) if t is not None else []
        if len(w) >= max(rule.min_words, rule.n):
            sets[k] = {tuple(w[i : i + rule.n]) for i in range(len(w) - rule.n + 1)}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= rule.threshold * len(sets[a] | sets[b]) - 1e-12:
            out.add((a, b))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 60))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(len(w))
            action = rng.random()
            if action < 0.4:
                w[k] = rng.choice(vocabulary)
            elif action < 0.7:
                w.insert(k, rng.choice(vocabulary))
            elif len(w) > 20:
                del w[k]
        if rng.random() < 0.2:  # reorder
            k = rng.randrange(len(w))
            w = w[k:] + w[:k]
        out.append((i, " ".join(w).upper() if rng.random() < 0.3 else ", ".join(w)))
    return out


@pytest.mark.parametrize("rule", [RULE, Rule(3, 0.7, 3), Rule()])
def test_pairs_equal_brute_force(spark, rule):
    rows = texts(7, 120)
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # a hot group of copies: a quarter of all rows
    df = spark.createDataFrame(rows, "k long, t string")
    got = {tuple(r) for r in neardup.pairs(df, "t", "k", rule).collect()}
    assert got == brute(rows, rule)


def test_hot_lists_and_groups_are_split_without_loss(spark, monkeypatch):
    rows = texts(3, 80)
    levels = np.full(1 << neardup.LEAST_BITS, 100, np.uint8)  # every list counts as hot
    monkeypatch.setattr(neardup, "_level_table", lambda *_: levels)
    monkeypatch.setattr(neardup, "GROUP_PAIRS", 5)
    monkeypatch.setattr(neardup, "PART_GRAMS", 10**18)  # the levels overstate the input
    df = spark.createDataFrame(rows, "k long, t string")
    assert {tuple(r) for r in neardup.pairs(df, "t", "k", RULE).collect()} == brute(rows, RULE)


def test_texts_whose_hashes_clash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_hash", lambda c: F.length(c).cast("long"))
    rows = texts(3, 60) + [(900 + i, "a b c d e f g " * 4 + x) for i, x in enumerate(("one", "two", "one", "six"))]
    df = spark.createDataFrame(rows, "k long, t string")
    assert {tuple(r) for r in neardup.pairs(df, "t", "k", RULE).collect()} == brute(rows, RULE)


def test_sketches_blocks_and_hubs_change_nothing(spark, monkeypatch):
    hub = " ".join(f"h{i}" for i in range(40))
    rows = texts(5, 60) + [(500 + i, " ".join(f"h{j}" if j != i else f"x{i}" for j in range(40))) for i in range(40)] + [(600 + i, hub) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, t string")
    expected = brute(rows, RULE)
    for name, value in (("COUNTER_CHARS", 0.001), ("COPY_BLOCK", 3), ("GROUP_PAIRS", 7), ("HELD_GRAMS", 50), ("BATCH", 5)):
        monkeypatch.setattr(neardup, name, value)
    monkeypatch.setattr(neardup, "LEAST_BITS", 10)
    monkeypatch.setattr(neardup, "MOST_BITS", 16)
    assert {tuple(r) for r in neardup.pairs(df, "t", "k", RULE).collect()} == expected


def test_packed_entries_come_back():
    rng = np.random.default_rng(1)
    sid, size, sketch, counts = rng.integers(-(2**62), 2**62, 5), rng.integers(1, 2**31, 5), rng.integers(0, 255, (5, 32)).astype(np.uint8), np.array([1, 3, 70_000, 2, 1])
    keys, pos = rng.integers(0, 2**63, counts.sum()).astype(np.uint64), rng.integers(0, 80_000, counts.sum())
    got = neardup.unpacked(5, int(counts.sum()), neardup.packed(sid, size, sketch, counts, keys, pos))
    for a, b in zip(got, (sid, size, sketch, counts, keys >> np.uint64(32), np.minimum(pos, 65_535))):
        assert (a == b).all()


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "short text"), (5, long), (6, long + " end"), (7, long), (7, long), (8, "İ ß ½ " * 30)]
    df = spark.createDataFrame(rows, "key long, text string").withColumn("sid", F.lit(1)).withColumn("a", F.lit("x"))
    assert {tuple(r) for r in neardup.pairs(df, "text", "key", RULE).collect()} == {(5, 6), (5, 7), (6, 7)}
    got = {r.key: (r.class_key, r.copies, r.links) for r in neardup.classes(df, "text", "key", RULE).collect()}
    assert got[5] == (5, 3, 1) and got[6] == (6, 1, 1) and got[4] == (4, 1, 0) and 1 not in got


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert neardup.pairs(df, "t", "k").count() == 0 and neardup.classes(df, "t", "k").count() == 0


def test_derived_overlaps_equal_counted_ones():
    rng = random.Random(1)
    base = set(range(100))
    sets = {i: frozenset((base - set(rng.sample(range(100), 8))) | {1000 * i + j for j in range(5)}) for i in range(12)}
    pairs = list(itertools.combinations(range(12), 2))
    rng.shuffle(pairs)
    got = {(a, b): o for a, b, o, _, _ in neardup.verified(Rule(3, 0.5, 3), pairs, sets)}
    assert got == {(a, b): len(sets[a] & sets[b]) for a, b in pairs}
