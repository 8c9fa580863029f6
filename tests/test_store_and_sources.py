"""The store on disk, archives, PDF text, media folders, and application state."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import appstate as A
from corpusmill.operators import entities as E
from corpusmill.operators import graph as G
from corpusmill.operators import retrieval as R
from corpusmill.operators import store
from corpusmill.sources import archive, media, pdf

SCHEMA = "chunk_key long, collection string, episode_num int, text string"


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_an_ingest_rewrites_one_part(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(k, c, e, f"{c} {e} {k}") for k, (c, e) in enumerate([("a", 1), ("a", 2), ("a", 65), ("b", 1), ("b b/ü", 3)])]
    store.replace_episodes(path, spark.createDataFrame(rows, SCHEMA))
    before = files(path)
    store.replace_episodes(path, spark.createDataFrame([(9, "a", 1, "new")], SCHEMA))
    after = files(path)
    assert {os.path.dirname(p) for p in after if p not in before} == {os.path.join(path, "collection=a", "episode_bucket=1")}
    read = lambda: {(r.chunk_key, r.collection, r.episode_num, r.text) for r in store.read_store(spark, path).collect()}
    assert read() == {(9, "a", 1, "new"), *rows[1:]}
    store.delete_from_store(spark, path, "b b/ü")
    store.delete_from_store(spark, path, "a", 65)
    store.delete_from_store(spark, path, "a", 2)
    assert read() == {(9, "a", 1, "new"), rows[3]}
    added = store.ingest(path, spark.createDataFrame([(20, "b", 1, "b 1 3"), (21, "b", 2, "fresh"), (22, "b", 3, "b 1 3")], SCHEMA))
    assert {r.chunk_key for r in added.collect()} == {20, 21}
    assert read() == {(9, "a", 1, "new"), (20, "b", 1, "b 1 3"), (21, "b", 2, "fresh")}
    store.compact(spark, path, "b")
    assert len(read()) == 3
    store.delete_from_store(spark, path, "none")


def test_postings_follow_the_store(spark, tmp_path):
    path = str(tmp_path / "index")
    df = spark.createDataFrame([(1, "a", 1, "red lamp lamp"), (2, "a", 2, "blue lamp"), (3, "b", 1, None)], SCHEMA)
    R.update_postings(path, df)
    R.update_postings(path, spark.createDataFrame([(1, "a", 1, "green")], SCHEMA))
    got = {(r.term, r.chunk_key, r.dl, r.tf) for r in store.read_store(spark, path).collect()}
    assert got == {("green", 1, 1, 1), ("blue", 2, 2, 1), ("lamp", 2, 2, 1)}


def test_index_and_graph_come_back(spark, tmp_path):
    found = spark.createDataFrame([(1, "s", "Anna Lind", "PERSON"), (2, "t", "Anna Lindt", "PERSON"), (2, "t", "Borg", "ORG")], "chunk_key long, source string, name string, type string")
    clustered = spark.createDataFrame([("Anna Lind", "Anna Lind"), ("Anna Lindt", "Anna Lind"), ("Borg", "Borg")], "name string, canonical string")
    assert E.load_index(spark, str(tmp_path)) is None and G.load_graph(spark, str(tmp_path)) is None
    E.save_index(found, clustered, str(tmp_path))
    summaries, variants = E.load_index(spark, str(tmp_path))
    assert summaries.where("canonical = 'Anna Lind'").first().mentions == 2 and variants.count() == 3
    asked = spark.createDataFrame([("the anna lind's", "PERSON"), ("Anna Linde", "PERSON"), ("Anna Linde", "ORG"), ("Borh", ""), ("Zed", ""), (None, "")], "n string, k string")
    got = {r.name: r.canonical for r in E.resolve(asked.where("k <> 'ORG'"), "n", variants).collect()}
    assert got == {"the anna lind's": "Anna Lind", "Anna Linde": "Anna Lind", "Borh": None, "Zed": None}  # short names must be equal
    typed = E.resolve(asked, "n", variants, kinds=summaries, kind="k").where("name = 'Anna Linde'")
    assert sorted((r.canonical or "") for r in typed.collect()) == ["", "Anna Lind"]
    assert {r.chunk_key: r.entities for r in E.labels_of(found, clustered).collect()} == {1: ["Anna Lind"], 2: ["Anna Lind", "Borg"]}


@pytest.fixture(scope="module")
def graph(spark):
    groups = ["abcd", "efgh", "ijkl"]
    pairs = [(x, y, 0.9) for g in groups for x in g for y in g if x < y] + [("d", "e", 0.1), ("d", "i", 0.1), ("h", "i", 0.1)]
    e = spark.createDataFrame([(x, y, 3, w) for x, y, w in pairs], "a string, b string, cooccur long, npmi double").cache()
    v = spark.createDataFrame([(x, i) for i, x in enumerate("abcdefghijklz")], "entity string, docfreq long").cache()
    return v, e, G.communities(v, e).cache()


def test_communities_of_most_modularity(graph):
    v, e, labels = graph
    assert {r.entity: r.community for r in labels.collect()} == {**{x: g[0] for g in ("abcd", "efgh", "ijkl") for x in g}, "z": "z"}
    around = G.both_ways(e).select("entity", "neighbor", F.col("npmi").alias("w"))
    total = 2 * (18 * 0.9 + 0.3)
    sides = [2 * 6 * 0.9 + 0.2, 2 * 6 * 0.9 + 0.2, 2 * 6 * 0.9 + 0.2]
    assert abs(G.modularity(around, labels) - (18 * 1.8 / total - sum(s * s for s in sides) / total**2)) < 1e-9
    assert {(r.entity, r.communities_bridged, r.degree) for r in G.bridges(v, e, labels).collect()} == {("d", 3, 5), ("i", 3, 5)}
    assert [(r.member, r["rank"]) for r in G.members(labels, v, labels.where("entity = 'a'"), 2).orderBy("rank").collect()] == [("d", 1), ("c", 2)]
    assert G.members(labels, v, labels).count() == 36


def test_no_graph_has_no_communities(spark, graph):
    v, e, _ = graph
    assert G.communities(v.limit(0), e.limit(0)).count() == 0 and {r.community for r in G.communities(v, e.limit(0)).collect()} == set("abcdefghijklz")


def test_chunks_of_very_many_entities(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, f"e{i:02}") for i in range(30)] + [(2, "e00"), (2, "e01")], "chunk_key long, entity string")
    whole = {tuple(r) for r in G.cooccurrence(pairs).collect()}
    monkeypatch.setattr(G, "BLOCK", 7)
    assert {tuple(r) for r in G.cooccurrence(pairs).collect()} == whole and len(whole) == 435


def span(text, flags=0, size=10.0, font="Serif"):
    return (text, font, flags, size)


def test_spans_to_markdown(spark):
    lines = [(1, 1, 0.0, [span("Heading here", 16, 12.0)]), (1, 2, 0.0, [span("plain "), span("text ")]), (1, 3, 10.0, [span("def f():", 8)]), (1, 4, 0.0, [span("  ")]), (1, 5, 22.0, [span("return", 0, 10.0, "Courier")]), (1, 6, 0.0, [span("after")]), (2, 1, 0.0, [span("x = 1", 8)]), (2, 2, 0.0, [span("big " * 21, 16, 15.0)])]
    df = spark.createDataFrame([("d", *x) for x in lines], "doc string, page int, line_no int, x0 double, spans array<struct<text:string,font:string,flags:int,size:double>>")
    got = pdf.markdown_of(df, "doc").first().markdown
    assert got.startswith("\n<!--PAGE:1-->\n\n\n## Heading here\n") and "\nplain text\n" in got
    assert "```\ndef f():\n\n  return\n```\n\nafter" in got and "```\nx = 1\n```\n\n\n# big big" in got
    assert [(s["title"], s["page_num"]) for s in pdf.sections_of(got)][:1] == [("Heading here", 1)]


def test_pdf_sections():
    md = "<!--PAGE:1-->\nintro\n# One\nbody\n<!--PAGE:2-->\nmore\n## 12\nfolded\n### Two\n\n# Three\nend"
    assert [(s["title"], s["text"], s["page_num"]) for s in pdf.header_sections(md)] == [("(preamble)", "intro", 1), ("One", "body\n\nmore\n\n12\nfolded", 1), ("Three", "end", 2)]
    assert pdf.header_sections("# 12\nx")[0]["title"] == "(preamble)" and pdf.header_sections("<!--PAGE:3-->  ") == [] and pdf.header_sections("<!--PAGE:3--> a")[0]["title"] == "(untitled)"
    long = "w" * 201
    text = f"Chapter 1: Start 7\nshort\n<!--PAGE:4-->\nChapter 1: Start\n{long}\nChapter 2. Next\n{long}\nChapter 3. Tiny\nx"
    assert [(s["title"], len(s["text"]), s["page_num"]) for s in pdf.chapter_sections(text)] == [("Chapter 1: Start", 201, 4), ("Chapter 2. Next", 201, 4)]
    assert pdf.chapter_sections("Chapter 1: a\nChapter 2: b") == [] and len(pdf.sections_of(text)) == 2


def test_media_folders(spark, tmp_path):
    for n in ("b.mp4", "a.MP3", "notes.txt", "c.wav"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "b.srt").write_text(media.format_srt([(i * 30.0, i * 30.0 + 30, f"s{i}") for i in range(5)]))
    got = [(r.episode_title, r.episode_num, bool(r.srt_path)) for r in media.media_files(spark, str(tmp_path)).orderBy("episode_num").collect()]
    assert got == [("a", 1, False), ("b", 2, True), ("c", 3, False)]
    chunks = media.ingest_srt(spark, str(tmp_path), "My: Talks", "Music").orderBy("chunk_index").collect()
    assert [(c.collection, c.topic, c.episode_title, c.start_sec, c.time_label) for c in chunks][:2] == [("My_Talks", "music", "b", 0, ""), ("My_Talks", "music", "b", 60, "01:00")]
    assert media.windows(65) == [(0, 30), (30, 60), (60, 65)] and media.windows(0) == []
    assert media.transcribed(65, lambda a, b: "hi " if a else None) == [(30, 60, "hi"), (60, 65, "hi")]
    assert media.transcribed(65, lambda a, b: "all" if b - a > 30 else "") == [(0.0, 65, "all")]


def test_summaries_of_archives(spark, tmp_path):
    archive.save(str(tmp_path), "c", {"book_summary.json": {"overview": "o", "main_themes": [{"theme": "t1"}, {"title": "t2"}], "tags": ["x"]}, "meta.json": {"collection_display": "C", "topic": "music", "chunk_count": 4}})
    archive.save(str(tmp_path), "d", {"book_summary.json": "broken"})
    archive.save(str(tmp_path), "e", {"book_summary.json": {"overview": None}})
    got = {r.collection: r for r in archive.read_summaries(spark, str(tmp_path)).collect()}
    assert set(got) == {"c", "e"} and got["c"].display_name == "C" and got["c"].themes == ["t1", "t2"] and got["c"].chunk_count == 4 and got["e"].overview == "" and got["e"].tags == []


class Echo:
    def chat(self, messages, model=None):
        return "reply to " + messages[-1]["content"][:5]


def test_application_state(spark):
    t = datetime(2024, 1, 1)
    row = A.new_interaction("s", "get_context", shown=["1", "2"], fetched=["2"], at=t)
    assert json.loads(row[7]) == ["1"] and A.new_interaction("s", "search", shown=["1"])[7] is None
    with pytest.raises(ValueError):
        A.new_interaction("s", "delete")
    log = spark.createDataFrame([row, A.new_interaction("s", "rate_result", rated=["2"], rating=1, at=t)], A.INTERACTIONS)
    from corpusmill.operators import feedback

    assert {(r.chunk_id, r.fetches, r.ignores, r.explicit_up) for r in feedback.chunk_ratings(log).collect()} == {("1", 0, 1, 0), ("2", 1, 0, 1)}
    assert {r.chunk_id for r in feedback.fetched(log, spark.createDataFrame([(1, "s", t)], "k long, session_id string, now timestamp"), "k").collect()} == {"2"}
    assert A.without_fetches(log, "s").count() == 1
    sessions = spark.createDataFrame([A.new_session("Old", at=t)], A.SESSIONS)
    old = sessions.first().id
    messages = [{"role": "user", "content": "q" * 100}]
    assert A.resumed_session(sessions, messages, old) == (old, None) and A.resumed_session(sessions, messages, "x")[1][1] == "q" * 80
    reply, new, said = A.chat(Echo(), sessions, messages, lambda q: ("ctx", [{"id": 1}]), at=t)
    assert reply == "reply to qqqqq" and len(new) == 1 and [m[2] for m in said] == ["user", "assistant"] and {m[1] for m in said} == {new[0][0]} and json.loads(said[1][4]) == [{"id": 1}]

    def fails(_):
        raise RuntimeError

    assert A.chat(Echo(), sessions, messages, fails, old)[1] == []
    clock = iter(datetime(2024, 1, 1, h) for h in range(9))
    log = A.ingest_all([("a", "p"), ("b", "q")], lambda c, p: 3 if c == "a" else fails(p), lambda: next(clock))
    states = {r.collection: r for r in A.ingest_states(spark.createDataFrame([*log, A.new_ingest("c", "r", at=t)], A.INGESTS)).collect()}
    assert states["a"].status == "done" and states["a"].chunks == 3 and states["a"].completed_at == datetime(2024, 1, 1, 1) and states["b"].error.startswith("RuntimeError") and states["c"].completed_at is None
    listed = spark.createDataFrame([("music", "c1", "One"), ("", "c2", "Two")], "topic string, collection string, collection_display string")
    assert A.instructions(listed, 7, 2, "m") == "7 chunks in 2 collections (One, Two). Topics: music. 2 entities connect several sources." and A.instructions(listed.limit(0), 0, 0).startswith("Nothing")


class Longest:
    def score(self, query, texts):
        if query == "broken":
            raise RuntimeError("no model")
        return [len(t) / 100 for t in texts]


class People:
    def entities(self, text):
        return [(w, "PERSON") for w in text.split() if w.istitle()]


class Cutter:
    def chat(self, messages, model=None):
        q = messages[0]["content"].splitlines()[-1]
        if q == "broken":
            raise RuntimeError("down")
        return "1. yeast in bread\n2. which star is the sun" if q == "two things" else "yeast in bread"


def test_search_with_models(spark):
    docs = ["cats chase mice", "the sun is a star", "the sun is a very bright star indeed", "bread needs yeast", "guitars have strings and yeast"]
    blank = {c: F.lit("") for c in ("keywords", "entities", "concept_tags", "topic", "subtopic")}
    c = spark.createDataFrame([(i, str(i), "c", 1, i, 0, 0, t) for i, t in enumerate(docs)], "chunk_key long, id string, collection string, episode_num int, chunk_index int, start_sec int, end_sec int, text string").withColumns({**blank, "importance": F.lit(3)})
    v = spark.createDataFrame([], "chunk_key long, vector array<double>")
    q = spark.createDataFrame([(1, "which star is the sun", None), (2, "broken", None), (3, "two things", None), (4, "yeast", None)], "qid long, query string, vector array<double>")
    got = {(r.qid, r["rank"]): (r.chunk_key, r.score) for r in R.search(c, v, q, 2, reranker=Longest()).collect()}
    assert got == {(1, 1): (2, 0.36), (1, 2): (1, 0.17), (4, 1): (4, 0.3), (4, 2): (3, 0.17)}
    found = R.search(c, v, q, 1, around=True, seen=spark.createDataFrame([(1, "1")], "qid long, chunk_id string"))
    one = {r.qid: r for r in found.collect()}
    assert one[1].score == 0.5 and one[1].text.startswith("cats chase mice\n\nthe sun")
    assert R.search(c, v, q, 2, R.of_topic("Music")).count() == 0 and R.of_topic() is None
    hops = R.decomposed(q, Cutter())
    assert {(r.qid, r.hop) for r in hops.collect()} == {(3, 0), (3, 1), (1, 0), (4, 0)}
    sub = hops.withColumn("vector", F.lit(None).cast("array<double>"))
    multi = {}
    for r in R.multi_hop(c, v, q, sub, 3, reranker=Longest()).orderBy("qid", "rank").collect():
        multi.setdefault(r.qid, []).append(r.chunk_key)
    assert multi[3] == [2, 4, 1] and multi[4] == [4, 3] and multi[1][0] == 2 and 2 not in multi
    names = R.recognized(spark.createDataFrame([(1, "ask Anna"), (2, None)], "qid long, query string"), "qid", "query", People(), spark.createDataFrame([("Anna", "Anna Lind"), ("A. Lind", "Anna Lind")], "name string, canonical string"))
    assert {r.qid: r.asked for r in names.collect()} == {1: ["a. lind", "anna"]}


def test_context_by_time_and_pages(spark):
    c = spark.createDataFrame([(i, str(i), "c", 1, i * 60, i * 60 + 60, i, "x" * 400) for i in range(10)] + [(50 + i, str(50 + i), "d", 1, 0, 0, i, "y" * 40) for i in range(10)], "chunk_key long, id string, collection string, episode_num int, start_sec int, end_sec int, chunk_index int, text string")
    t = spark.createDataFrame([(1, "c", 1, 300, 360, 5, "around", 240), (2, "c", 1, 300, 360, 5, "before", 120), (3, "c", 1, 300, 360, 5, "after", 120), (4, "d", 1, 0, 0, 4, "after", 30), (5, "c", 1, 300, 0, 0, "around", 120)], "tid long, collection string, episode_num int, start_sec int, end_sec int, chunk_index int, direction string, amount int")
    seen = spark.createDataFrame([(1, "4")], "tid long, chunk_id string")
    got = {}
    for r in R.context(t, c, seen, 250).orderBy("tid", "place").collect():
        got.setdefault(r.tid, []).append((r.chunk_key, r.page))
    assert got == {1: [(3, 1), (5, 1), (6, 2), (7, 2)], 2: [(3, 1), (4, 1), (5, 2)], 3: [(5, 1), (6, 1), (7, 2)], 4: [(54, 1), (55, 1), (56, 1)], 5: [(4, 1), (5, 1), (6, 2)]}
    assert {r.page for r in R.context(t, c, None, 0).collect()} == {1} and R.context(t.limit(0), c).count() == 0
