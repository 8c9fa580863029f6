"""Co-occurrence and names."""

import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import cooccurrence as co
from corpusmill.llm import queries, variants
from corpusmill.llm.names_json import named


def test_names_in_json():
    assert named('[{"name": " A \\n B ", "type": "ORG"}, {"name": null}, 3, "x", {"type": "ORG"}, {"name": "C", "type": 5}, {"name": ""}]') == [("A B", "ORG"), ("C", None)]
    for bad in (None, "", "n/a", "null", '{"name": "A"}', '[{"name": "A"}', '[{"name": "A"}] x', "[NaN]", "[{'name': 'A'}]", '[{"name": "\\ud800"}]', "[" * 100_000):
        assert named(bad) == []


def sets_df(spark, rows):
    return spark.createDataFrame([("f", sorted(r)) for r in rows if r], "field string, items array<string>")


def test_counts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [set(rng.sample("abcdefghijkl", rng.randint(0, 8))) for _ in range(200)] + [{"a", "b"}] * 100
    expected = Counter(p for r in rows for p in itertools.combinations(sorted(r), 2))
    for block in (256, 3):  # records cut into blocks give the same counts
        monkeypatch.setattr(co, "BLOCK", block)
        got = {(r.a, r.b): r.shared for r in co.pair_counts(sets_df(spark, rows)).collect()}
        assert got == expected


def test_case_filter(spark):
    rows = [{"x", "y"}] * 5 + [{"x"}] * 2 + [{"z", str(i)} for i in range(93)]
    got = co.surprising_pairs(sets_df(spark, rows), 4, 8).collect()
    assert [(r.item_a, r.item_b, r.shared, r.count_a, r.count_b, r.records) for r in got] == [("x", "y", 5, 7, 5, 100)]
    assert got[0].expected < 1 and abs(got[0].log10_p - math.log10(0.354**5 * math.exp(-0.354) / 120)) < 0.1
    assert co.surprising_pairs(sets_df(spark, []), 4, 8).count() == 0


def test_false_discovery_rate(spark):
    rng = random.Random(8)
    rows = [set(rng.sample([f"i{k}" for k in range(40)], 4)) for _ in range(600)]
    rows += [{"p", "q", f"i{rng.randrange(40)}"} for _ in range(30)]
    sets = sets_df(spark, rows)
    got = {(r.item_a, r.item_b): r.q for r in co.with_false_discovery(co.surprising_pairs(sets), sets).collect()}
    assert got["p", "q"] < 1e-6 and sum(q <= 0.01 for q in got.values()) <= 3


def test_fit_meets_margins():
    counts, items = np.array([1.0, 3, 10, 60]), np.array([50.0, 20, 8, 1])
    sizes, records = np.array([1.0, 2, 4]), np.array([80.0, 65, 10])
    x, y = co.fit(counts, items, sizes, records)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((p * records).sum(1), counts, rtol=1e-4) and np.allclose((p.T * items).sum(1), sizes, rtol=1e-4)


def test_an_unfinished_fit_is_an_error(monkeypatch):
    args = np.array([1.0, 3, 10, 60]), np.array([50.0, 20, 8, 1]), np.array([1.0, 2, 4]), np.array([80.0, 65, 10])
    whole = co.fit(*args)
    monkeypatch.setattr(co, "FIT_CELLS", 4)  # a row at a time
    assert all(np.allclose(a, b) for a, b in zip(whole, co.fit(*args)))
    monkeypatch.setattr(co, "STEPS", 1)
    with pytest.raises(RuntimeError):
        co.fit(*args)


def test_pruning_loses_no_pair(spark, monkeypatch):
    rng = random.Random(5)
    rows = [set(rng.sample([f"i{int(k)}" for k in range(60)], rng.randint(1, 6))) | ({"hot"} if rng.random() < 0.4 else set()) for _ in range(300)] + [{"u", "v"}] * 6 + [{"once", "hot"}]
    count, both = Counter(i for r in rows for i in r), Counter(p for r in rows for p in itertools.combinations(sorted(r), 2))
    expected = {p for p, k in both.items() if k >= 4 and len(rows) * k >= 3 * count[p[0]] * count[p[1]]}
    for bits in (1 << 27, 1 << 10):  # a full filter keeps all items
        monkeypatch.setattr(co, "MOST_BITS", bits)
        assert {(r.item_a, r.item_b) for r in co.surprising_pairs(sets_df(spark, rows), 4, 3, tails=False).collect()} == expected and ("u", "v") in expected
    left = {i for r in co.possible(sets_df(spark, rows), spark.createDataFrame([("f", i, n) for i, n in count.items()], "field string, item string, n long"), {"f": len(rows)}, 4, 3).collect() for i in r["items"]}
    assert "hot" not in left and "u" in left


def test_tails_equal_exact_convolution():
    n, p = np.array([40, 25, 10]), np.array([[0.02, 0.05, 0.1], [0.3, 0.2, 0.01], [1e-4, 2e-4, 1e-3]])
    for row in p:
        exact = np.ones(1)
        for m, q in zip(n, row):
            for _ in range(m):
                exact = np.convolve(exact, [1 - q, q])
        for k in (1, 2, 4, 8, 15):
            tail = exact[k:].sum()
            got = co.log10_tail(np.array([k]), row[None, :], n)[0]
            assert abs(got - math.log10(tail)) < 0.12 or tail > 0.05 and abs(10**got - tail) < 0.1, (row, k, tail, 10**got)


def chunks(spark, names):
    rows = [(json.dumps([{"name": n, "type": t}]),) for n, t, k in names for _ in range(k)]
    return spark.createDataFrame(rows + [(None,), ("",), ("n/a",), ("[3]",)], "entities string").withColumn("name", F.lit("x")).withColumn("node", F.lit(1))


PEOPLE = [("Katherine Tolvit", 9), ("kate tolvit", 2), ("K. Tolvit", 2), ("Katehrine Tolvit", 1), ("Dr. Katherine Tolvit", 1), ("Tolvit, Katherine", 1), ("Tolvit, K. A.", 1), ("Katherine Tólvit", 1), ("Katherine Tolvit's", 1), ("KATHERINE TOLVIT", 1), ("K.A. Tollvit", 1), ("Katherine A. Tolvit", 1)]
BODIES = [("Borg Manufacturing Company", 9), ("Borg Mfg. Co.", 2), ("Borg MC", 1), ("the Borg Mfg Co", 1), ("Manufacturing Company, Borg", 1), ("BORG MANUFACTURING COMPANY", 1)]
OTHERS = [("Michael Tolvit", "PERSON", 5), ("Borg Foundation", "ORG", 5), ("Tolvit Pro", "PRODUCT", 3), ("Tolvit 2", "PRODUCT", 3), ("North Borg", "LOC", 3), ("Univ. of Torvale", "ORG", 2), ("Torvale University", "ORG", 3)]


def test_variants(spark):
    names = [(n, "PERSON", k) for n, k in PEOPLE] + [(n, "ORG", k) for n, k in BODIES] + OTHERS
    got = {tuple(r) for r in variants.pairs(chunks(spark, names), "entities").collect()}
    expected = {tuple(sorted(p)) for group in ([n for n, _ in PEOPLE], [n for n, _ in BODIES], ["Univ. of Torvale", "Torvale University"]) for p in itertools.combinations(group, 2)}
    assert got == expected


def test_a_rewriting_that_fits_two_links_none(spark):
    names = [("Theodore Rask", "PERSON", 5), ("Edward Rask", "PERSON", 5), ("Ted Rask", "PERSON", 1), ("E. Rask", "PERSON", 1), ("Mary Lind", "PERSON", 3), ("Maud Lind", "PERSON", 3), ("M. Lind", "PERSON", 1)]
    assert {tuple(r) for r in variants.pairs(chunks(spark, names), "entities").collect()} == {("E. Rask", "Edward Rask")}


def test_no_names(spark):
    assert variants.pairs(chunks(spark, []), "entities").count() == 0
    assert variants.pairs(chunks(spark, []).limit(0), "entities").count() == 0


@pytest.mark.parametrize("a,b,yes", [("abc", "abc", True), ("abc", "acb", True), ("abc", "ab", True), ("abc", "xabc", True), ("abc", "abd", True), ("abc", "bca", False), ("abcd", "badc", False), ("", "", True), ("", "ab", False)])
def test_one_edit(a, b, yes):
    assert variants.one_edit(a, b) is yes and variants.one_edit(b, a) is yes


def test_long_names_chains_and_legal_forms(spark):
    names = [("Maria del Carmen Lopez Garcia", "PERSON", 3), ("MARIA DEL CARMEN LOPEZ GARCÍA", "PERSON", 1), ("Lopez Garcia, Maria del Carmen", "PERSON", 1)]
    chain = ["abcdefghij", "abcdefghik", "abcdefghlk", "abcdefgmlk", "abcdefnmlk", "abcdeonmlk", "abcdponmlk"]  # each one letter from the one before
    names += [(f"Quilla {c}", "PERSON", 20 - 2 * i) for i, c in enumerate(chain)]
    forms = [["Acme GmbH", "Acme Gesellschaft mit beschränkter Haftung", "ACME GMBH"], ["Bord LLC", "Bord Limited Liability Company"], ["Corda Plc", "Corda Public Limited Company"], ["Dorn AG", "Dorn Aktiengesellschaft"]]
    names += [(n, "ORG", 9 - i) for f in forms for i, n in enumerate(f)]
    got = {tuple(r) for r in variants.pairs(chunks(spark, names), "entities").collect()}
    groups = [[n for n, _, _ in names[:3]], [f"Quilla {c}" for c in chain], *forms]
    assert got == {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}


def test_other_tables_and_scores(spark):
    names = [("Wilhelmina Rask", "PERSON", 4), ("Minna Rask", "PERSON", 1), ("Norvale Werk", "ORG", 3), ("Norvale W.", "ORG", 1), ("Norvale Wk", "ORG", 2)]
    tables = variants.Tables(nicknames={"wilhelmina": "minna"}, forms={"werk": "wk"})
    assert variants.pairs(chunks(spark, names), "entities").where("name_a = 'Minna Rask'").count() == 0
    got = {r.name: (r.entity, r.score) for r in variants.clusters(chunks(spark, names), "entities", tables).collect()}
    assert got["Minna Rask"] == got["Wilhelmina Rask"] and got["Norvale Wk"][0] == got["Norvale Werk"][0] and all(0 < s <= 1 for _, s in got.values())


def test_variants_in_the_other_order(spark):
    names = [("Zoltan Wedosi", 3), ("wedosi zoltan", 1), ("Wedosi Zoltn", 1), ("Zoltan Adam Brek", 3), ("Brek Zoltan Adam", 1), ("Brek Zoltan Peter", 1), ("James Henry", 2), ("Henry James", 2)]
    got = {tuple(r) for r in variants.pairs(chunks(spark, [(n, "PERSON", k) for n, k in names]), "entities").collect()}
    assert got == {("Zoltan Wedosi", "wedosi zoltan"), ("Wedosi Zoltn", "Zoltan Wedosi"), ("Wedosi Zoltn", "wedosi zoltan"), ("Brek Zoltan Adam", "Zoltan Adam Brek")}


def test_surprise_of_one_shared_record(spark, tmp_path):
    rows = [f"c{i % 6},c{(i + 1 + i // 6 % 5) % 6}" for i in range(20_000)] + ["rare,scarce"]
    spark.createDataFrame([(None, t) for t in rows], "entities string, concept_tags string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {(r.item_a, r.item_b): r.shared for r in queries.p3_surprise(spark, str(tmp_path)).collect()}
    assert got["rare", "scarce"] == 1


def _stated(rows, min_shared, min_lift):
    count, both = Counter(i for r in rows for i in r), Counter(p for r in rows for p in itertools.combinations(sorted(r), 2))
    return {p for p, k in both.items() if k >= min_shared and len(rows) * k >= min_lift * count[p[0]] * count[p[1]]}, both


def test_cases_are_found_by_the_null_and_none_is_lost(spark):
    rng = random.Random(12)
    flat = [set(rng.sample([f"i{k}" for k in range(90)], rng.randint(1, 6))) for _ in range(900)] + [{"u", "v"}] * 4 + [{"u", f"i{k}"} for k in range(8)] + [{"v", f"i{k}"} for k in range(9, 30)]
    skewed = [{f"i{int(rng.paretovariate(0.7))}" for _ in range(int(rng.paretovariate(0.9)) % 60 + 1)} for _ in range(600)]
    nested = [{f"i{j}" for j in range(k + 1)} for k in range(40)]
    hot = [{"h", str(i % 90)} for i in range(360)] + [{str(i) for i in range(90)} | {"h"}] * 2
    for rows, limits in ((flat, (4, 8)), (flat, (2, 3)), (skewed, (4, 8)), (skewed, (3, 2)), (nested, (4, 8)), (hot, (4, 8)), (hot, (2, 2)), ([{"a", "b"}] * 9, (4, 1))):
        expected, both = _stated(rows, *limits)
        assert {(r.item_a, r.item_b) for r in co.cases(sets_df(spark, rows), *limits).collect()} == expected
    assert {(r.item_a, r.item_b): r.shared for r in co.cases(sets_df(spark, flat), 4, 8).collect()}["u", "v"] == 4
    assert co.cases(sets_df(spark, []), 4, 8).count() == 0


def test_the_null_drops_pairs_before_the_limits(spark, monkeypatch):
    rng = random.Random(13)
    rows = [set(rng.sample([f"i{k}" for k in range(60)], 3)) for _ in range(700)] + [{f"u{k}", f"v{k}"} for k in range(60)] * 5 + [{"once", "twice"}, {"twice"}]
    monkeypatch.setattr(co, "_limited", lambda df, *_: df)
    kept = {(r.item_a, r.item_b): r for r in co.cases(sets_df(spark, rows), 4, 8).collect()}
    expected, both = _stated(rows, 4, 8)
    assert ("u0", "v0") in expected and expected <= set(kept) and len(kept) < len(both) / 4
    p = 10 ** (math.floor(kept["u0", "v0"].log10_p * 10) / 10 + 0.1)  # 180 items are in 4 records or more, and the planted pairs are the first 60 of all
    assert kept["u0", "v0"].rate == pytest.approx(p * 180 * 179 / 2 / 60)


def test_found_cases_come_by_the_null(spark, tmp_path, monkeypatch):
    rows = [f"c{i % 40},c{(i * 7 + 1 + i // 40) % 40}" for i in range(2_000)] + ["rare,scarce"] * 4
    spark.createDataFrame([(None, t) for t in rows], "entities string, concept_tags string").write.parquet(str(tmp_path / "chunks.parquet"))
    found = lambda: {tuple(r) for r in queries.p3_found(spark, str(tmp_path)).collect()}
    assert ("concept_tags", "rare", "scarce") in found()
    monkeypatch.setattr(co, "least_surprise", lambda *_: -300.0)  # nothing surprises so much
    assert found() == set()


def test_a_null_that_cant_be_fitted_loses_no_case(spark, monkeypatch):
    rows = [{"x", "y"}] * 5 + [{"x"}] * 2 + [{"z", str(i)} for i in range(93)]
    monkeypatch.setattr(co, "STEPS", 0)
    with pytest.warns(UserWarning, match="isn't fitted"):
        assert [(r.item_a, r.item_b) for r in co.cases(sets_df(spark, rows), 4, 8).collect()] == [("x", "y")]
    with pytest.raises(RuntimeError):
        co.surprising_pairs(sets_df(spark, rows), 4, 8)


def test_a_case_surprises_at_least_so_much():
    rng = np.random.default_rng(3)
    bounded = 0
    for _ in range(200):
        n, y = np.ceil(10 ** rng.uniform(0, 5, 5)), np.sort(10 ** rng.uniform(-3, 3, 5))
        x = np.sort(10 ** rng.uniform(-7, 0, 12))
        p = 1 / (1 + 1 / np.outer(x, y))
        c, shared, lift = p @ n, int(rng.integers(2, 7)), float(rng.choice([2, 8, 20]))
        level = co.least_surprise((c, x, y, n), shared, lift)
        i, j = (v.ravel() for v in np.indices((12, 12)))
        k = np.maximum(shared, np.ceil(lift * c[i] * c[j] / n.sum()))
        ok = k <= np.minimum(c[i], c[j])
        if level < 0 and ok.any():
            bounded += 1
            assert co.log10_tail(k[ok], p[i[ok]] * p[j[ok]], n).max() <= level
    assert bounded > 30
