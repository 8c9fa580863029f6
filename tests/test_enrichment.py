"""Enrichment by a model that is a stub."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import enrich as E


class Model:
    """Answers each passage; ``wrong`` says which requests fail (an error, or a reply to give)."""

    def __init__(self, wrong=None, fallback=True):
        self.wrong, self.fallback, self.asked = wrong or {}, fallback, []

    def chat(self, messages, model=None):
        text = messages[-1]["content"]
        self.asked.append((model, text))
        if model is None:
            for mark, what in self.wrong.items():
                if mark in text:
                    if isinstance(what, Exception):
                        raise what
                    return what
        elif not self.fallback:
            raise RuntimeError("down")
        n = text.count("Passage ")
        return json.dumps([{"title": f"t{i}", "summary": "s", "questions": ["q"], "tags": ["a", "b"], "concept_tags": ["c", f"d{i}"], "importance": 4} for i in range(n)])


LONG = "word " * 20


def run(model, texts, **kw):
    waits = []
    asker = E.Asker(model, ("m1", "m2"), sleep=waits.append)
    return list(E.enriched(iter([{"text": t, **kw} for t in texts]), asker, "book", len(texts))), waits


def test_requests_of_five_with_short_and_cached_chunks():
    model = Model()
    out, _ = run(model, [LONG + str(i) for i in range(7)] + ["short"])
    assert Counter(x["how"] for x in out) == {"asked": 7, "short": 1} and len(model.asked) == 2
    assert out[0]["tags"] == "a, b" and out[0]["importance"] == 4 and "- c (5x)" in model.asked[1][1]
    out, _ = run(model, [LONG], cached={"title": "known", "importance": 2})
    assert out[0]["how"] == "cached" and out[0]["title"] == "known" and len(model.asked) == 2


def test_wrong_replies_go_to_other_models():
    for wrong in ('[{"title": "one"}]', "nothing", RuntimeError("boom"), RuntimeError("403 flagged")):
        model = Model({"Passage 1": wrong})
        out, waits = run(model, [LONG] * 2)
        assert [x["how"] for x in out] == ["fallback"] * 2 and model.asked[-1][0] == "m1" and not waits
        assert len(model.asked) == (2 if not isinstance(wrong, Exception) or "403" in str(wrong) else 4)
    out, waits = run(Model({"Passage": RuntimeError("429 rate limit")}, fallback=False), [LONG])
    assert [x["how"] for x in out] == ["failed"] and waits == [3, 6]


def test_errors_and_fields():
    assert isinstance(E.classified(RuntimeError("429")), E.Busy) and isinstance(E.classified(TimeoutError("x")), E.Busy) and isinstance(E.classified(RuntimeError("moderation")), E.Refused)
    assert E.filled({"importance": "high", "questions": None}) == {"title": "", "summary": "", "questions": "", "tags": "", "concept_tags": "", "semantic_key": "", "importance": 3}
    keys = E.RollingKeys(3)
    for i in range(60):
        keys.add([f"k{i}", "Common "], i)
    assert len(keys.seen) == 50 and keys.seen["common"] == (59, 60) and "k0" not in keys.seen
    with pytest.raises(RuntimeError):
        E.Asker(Model(fallback=False)).fall_back([])


class Sections:
    def __init__(self, fail=""):
        self.fail = fail

    def chat(self, messages, model=None):
        text = messages[-1]["content"]
        if self.fail and self.fail in text and model is None:
            raise RuntimeError("down")
        return json.dumps({"section_summary": "sum" + str(text.count("chunk")), "key_entities": ["e"], "notable_points": ["p", "p"], "section_themes": ["theme"], "ledger_updates": [{"concept_tag": "x", "action": "downweight"}, {"concept_tag": "new", "action": "add"}], "overview": "all", "tags": ["t"]})


def test_section_summaries():
    chunks = [{"text": f"chunk{i} " + "y" * 12_000, "concept_tags": "x, z"} for i in range(4)]
    s = E.section_summary(iter(chunks), E.Asker(Sections()), "b", "s")
    assert s["ledger"] == {"x": 0, "z": 4, "theme": 1, "new": 4} and s["key_entities"] == ["e"] and s["notable_points"] == ["p"]
    s = E.section_summary(iter(chunks), E.Asker(Sections("chunk2"), ("m",)), "b", "s")
    assert s["ledger"]["new"] == 4 and s["ledger"]["x"] == 0
    s = E.section_summary(iter(chunks), E.Asker(Sections("chunk")), "b", "s")
    assert s["summary"] == "" and s["ledger"] == {"x": 4, "z": 4}


def table(spark, rows):
    df = spark.createDataFrame(rows, "chunk_key long, collection string, episode_num int, chunk_index int, text string")
    blank = {c: F.lit("") for c in ("keywords", "entities", "section_heading", "chapter", "episode_title", "title", "summary", "collection_display", "content_hash")}
    return df.withColumns({**blank, "concept_tags": F.lit("x"), "importance": F.lit(3)})


def test_stages_over_tables(spark):
    rows = [(i, f"c{i % 2}", 1, i, f"{LONG} {i % 7}") for i in range(20)] + [(90, "c0", 1, 99, None), (91, "c1", 2, 0, "few words")]
    df = table(spark, rows)
    asker = E.Asker(Model())
    first = E.enrich_chunks(df, asker)
    got = {r.chunk_key: (r.how, r.title) for r in first.collect()}
    assert len(got) == 22 and got[90] == ("short", "") and got[91] == ("short", "") and all(h == "asked" for h, _ in list(got.values())[:20] if h != "short")
    cache = E.cached(first).cache()
    assert cache.count() == 7 and E.cached(first, cache).count() == 7
    again = E.enrich_chunks(df, E.Asker(Model({"Passage": RuntimeError("down")}, fallback=False)), cache)
    assert {r.how for r in again.collect()} == {"short", "cached"}
    sections = E.summarize_sections(df, E.Asker(Sections()))
    assert {r.collection: json.loads(r.ledger)["theme"] for r in sections.collect()} == {"c0": 1, "c1": 1}
    books = {r.collection: r for r in E.summarize_books(sections, E.Asker(Sections())).collect()}
    assert books["c0"].overview == "all" and books["c0"].error is None
    assert all(r.error and r.overview == "" for r in E.summarize_books(sections, E.Asker(Sections("Book"))).collect())
    assert E.enrich_chunks(df.limit(0), asker).count() == 0 and E.summarize_sections(df.limit(0), asker).count() == 0
    first.unpersist()


class Names:
    def entities(self, text):
        return [(w, "PERSON") for w in text.split() if w.istitle()]


class Says:
    def chat(self, messages, model=None):
        if "few" in messages[0]["content"]:
            raise RuntimeError("no")
        return " About. "


def test_keywords_entities_tags_and_prefixes(spark):
    df = table(spark, [(1, "c", 1, 0, "Anna met Anna and Bert near the old mill while lamp lamp lamp burned low there"), (2, "c", 1, 1, "few"), (3, "c", 1, 2, None)])
    got = {r.chunk_key: r for r in E.programmatic(df, Names()).collect()}
    assert json.loads(got[1].entities) == [{"name": "Anna", "type": "PERSON"}, {"name": "Bert", "type": "PERSON"}] and got[1].keywords.startswith("lamp, ") and got[3].entities == "" and got[2].keywords == ""
    assert [r.k for r in df.select(E.with_tags(F.lit(""), ["a", "b"]).alias("k")).limit(1).collect()] == ["a, b"] and df.select(E.with_tags(F.lit("z"), list("abcdefghij")).alias("k")).first().k == "z, a, b, c, d, e, f, g, h"

    texts = {r.chunk_key: r.text for r in E.with_prefixes(df.where("chunk_key < 3"), E.Asker(Says())).collect()}
    assert texts[1].startswith("About.\n\nAnna") and texts[2] == "few"


def test_keywords_equal_brute_force(spark, monkeypatch):
    import math
    import random

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["lamp", "mill", "stone", "river", "bread", "salt", f"x{rng.randrange(40)}"]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    grams = [E._grams(t) if t is not None else None for t in texts]
    n = sum(g is not None for g in grams)
    count = Counter(x for g in grams if g is not None for x in g)
    want = {}
    for i, t in enumerate(texts):
        if t is not None and len(t.split()) >= 10:
            want[i] = [g for _, g in sorted((-round(tf * math.log((1 + n) / (1 + count[g])), 6), g) for g, tf in grams[i].items())[:6]]
    for frequent in (100_000, 20, 1):
        monkeypatch.setattr(E, "FREQUENT", frequent)
        got = {}
        for r in E.keywords(df, "k", "t").orderBy("k", "rank").collect():
            got.setdefault(r.k, []).append(r.keyword)
        assert got == want
