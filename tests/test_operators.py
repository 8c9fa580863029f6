"""Hand-made cases of the core operators."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import similarity
from corpusmill.functions import text as T
from corpusmill.operators import chunking, enrich, graph, retrieval, store
from corpusmill.sources import archive, documents, media
from corpusmill.streaming import sessions


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_short_sections_join_under_the_longest():
    short, long = "a b c " * 8, "d e f " * 90
    s = [{"title": "Foreword", "text": short, "page_num": 3, "chapter": "front"}, {"title": "Harvest", "text": long, "page_num": 11, "chapter": "body"}]
    assert [(h, p, c) for _, h, p, c in chunking._sections(s, 512)] == [("Harvest", 11, "body")]
    s[1]["title"] = ""  # the longest has no title: its page and chapter stand under the other's
    assert [(h, p, c) for _, h, p, c in chunking._sections(s, 512)] == [("Foreword", 11, "body")]
    assert list(chunking._sections(None, 512)) == [] and list(chunking._sections([None, {"title": "t", "text": "\n"}], 512)) == []


def test_windows_overlap():
    rng = random.Random(1)
    for _ in range(50):
        t, segments = 0.0, []
        for i in range(rng.randint(0, 40)):
            d = rng.choice([5.0, 20.0, 100.0])
            segments.append((t, t + d, str(i)))
            t += d
        found = list(chunking.windows_of(iter(segments)))
        assert [w for x in found for w in x[0].split()][:1] == (["0"] if segments else [])
        assert {w for x in found for w in x[0].split()} == {s[2] for s in segments}
        assert all(x[2] - x[1] >= 90 for x in found[:-1])


def test_chunk_segments_streams_each_key(spark):
    rows = [("a", i, i * 20.0, i * 20.0 + 20, f"t{i}") for i in range(20)] + [("b", 0, 0.0, 5.0, "x"), ("b", 1, None, 5.0, "y")]
    df = spark.createDataFrame(rows, "k string, n int, s double, e double, t string")
    got = chunking.chunk_segments(df, ["k"], "s", "e", "t", ["n"]).collect()
    expected = list(chunking.windows_of(iter([(r[2], r[3], r[4]) for r in rows if r[0] == "a"])))
    assert [(r.text, r.start_sec, r.end_sec) for r in sorted(got, key=lambda r: r.chunk_index) if r.k == "a"] == expected
    assert [r.text for r in got if r.k == "b"] == ["x"]


def test_packed(spark):
    sizes = F.array(*(F.lit(x) for x in (500, 400, 100, 900, 0, 101)))
    assert one(spark, chunking.packed(sizes, 1000)) == [0, 0, 0, 1, 1, 2]


def test_wilson_and_npmi(spark):
    w = lambda a, b: one(spark, retrieval.wilson(F.lit(a), F.lit(b)))
    assert w(0, 0) == 0.5 and abs(w(10, 0) - 0.7224598) < 1e-6 and abs(w(1, 1) - (1.4604 - 1.96 * 0.3651**0.5) / 2.9208) < 1e-9
    n = lambda *x: one(spark, graph.npmi(*(F.lit(v) for v in x)))
    assert n(0, 1, 1, 10) == 0.0 and n(10, 10, 10, 10) == 1.0 and n(5, 5, 5, 10) == 1.0 and n(1, 5, 5, 10) < 0


def test_jaro_winkler_known_values():
    assert abs(similarity.jaro_winkler("martha", "marhta") - 0.961111) < 1e-6
    assert abs(similarity.jaro_winkler("dixon", "dicksonx") - 0.813333) < 1e-6
    assert similarity.jaro_winkler("", "a") == 0 and similarity.jaro_winkler("a", "a") == 1


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    names = {"".join(rng.choice("abcde ") for _ in range(rng.randint(1, 12))) for _ in range(150)}
    names |= {n + "x" for n in list(names)[:40]}
    got = {(r.a, r.b) for r in similarity.similar_pairs(spark.createDataFrame([(n,) for n in names] + [(None,), ("",)], "n string"), "n").collect()}
    assert got == {(a, b) for a in names for b in names if a < b and similarity.jaro_winkler(a, b) >= 0.9 - 1e-12}


@pytest.mark.parametrize("title,ok", [("Intro", True), ("", False), ("12", False), ("https://a", False), ("a....b", False), ("This is a long one, really so.", False), ("x" * 81, False), ("os.path(", False)])
def test_valid_heading(spark, title, ok):
    assert one(spark, T.valid_heading(F.lit(title))) is ok


def test_new_chunks(spark):
    df = spark.createDataFrame([(1, "c", 1, "old"), (2, "c", 2, "keep"), (3, "d", 1, "other")], "chunk_key long, collection string, episode_num int, text string")
    incoming = spark.createDataFrame([(5, "c", 3, "keep"), (6, "c", 2, "keep"), (7, "c", 3, None)], df.schema)
    assert {r.chunk_key for r in store.new_chunks(incoming, df).collect()} == {6, 7}
    assert {r.chunk_key for r in store.new_chunks(incoming, df, "global").collect()} == {7}


def test_titles_without_page_numbers(spark):
    assert one(spark, T.clean_title(F.lit("Chapter 2: Rivers  17 "))) == "Chapter 2: Rivers"


def test_running_counts_and_memory(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-01 00:10:00"), (1, "a", "2024-01-01 01:00:00"), (2, "a", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "user_id long, item string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, item string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("counts", sessions.running_counts(stream, "user_id", "item"), "complete"), ("memory_of", sessions.remembered(stream, "user_id", "item", "ts"), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {(1, "a", 2), (1, "b", 1), (2, "a", 1)}
    assert {tuple(r) for r in spark.table("memory_of").collect()} == {(1, 1), (2, 1)}


def test_contents_go_on_over_episodes(spark):
    rows = [(1, 1, 0, "A"), (2, 1, 1, "B"), (3, 2, 0, "B"), (4, 3, 0, "B"), (5, 3, 1, "A"), (6, 4, 0, "A")]
    df = spark.createDataFrame([(k, "c", e, i, h, "", f"id{k}", "text", "x" * 8) for k, e, i, h in rows], "chunk_key long, collection string, episode_num int, chunk_index int, section_heading string, chapter string, id string, source_type string, text string")
    got = sorted((r.episode_num, r.chunk_index, r.heading, r.chunk_count, r.token_count, r.first_chunk_id) for r in store.table_of_contents(df).collect())
    assert got == [(1, 0, "A", 1, 2, "id1"), (1, 1, "B", 3, 6, "id2"), (3, 1, "A", 2, 4, "id5")]


def test_gold_retrieval(spark):
    docs = ["cats chase mice", "rust is a language", "the sun is a star", "bread needs yeast", "guitars have strings"]
    d = spark.createDataFrame(list(enumerate(docs)), "chunk_key long, text string")
    q = spark.createDataFrame([(0, "which star is the sun"), (1, "yeast in bread"), (2, None)], "qid long, query string")
    assert {(r.qid, r.chunk_key) for r in retrieval.bm25(d, "chunk_key", "text", q, "qid", "query", 1).collect()} == {(0, 2), (1, 3)}
    e = enrich.HashingEmbedder()
    v = enrich.embed(d, "chunk_key", "text", e).withColumnRenamed("key", "chunk_key")
    qv = spark.createDataFrame([(0, e.embed(["sun star"])[0]), (1, None)], "qid long, v array<double>")
    assert retrieval.vector_search(v, "chunk_key", "vector", qv, "qid", "v", 1).first().chunk_key == 2
    assert retrieval.vector_search(v, "chunk_key", "vector", qv.limit(0), "qid", "v", 1).count() == 0


def test_ledger(spark):
    updates = [("a", "downweight"), ("a", "add"), ("a", "downweight"), ("a", "downweight"), ("a", "refine"), ("b", "mention"), ("b", "mention"), ("c", "keep")]
    assert enrich.ledger(updates) == {"a": 1, "b": 1}
    df = spark.createDataFrame([("s", i, *u) for i, u in enumerate(updates)], "k string, i int, tag string, act string")
    assert {(r.tag, r["count"]) for r in enrich.concept_ledger(df, ["k"], ["i"], "tag", "act").collect()} == {("a", 1), ("b", 1)}


@pytest.mark.parametrize("reply,value", [('```json\n[1, 2,]\n```', [1, 2]), ("so: ```[1]``` and ```\n[{'a': 'b'}]\n```", [{"a": "b"}]), ('I think {"a": [1]} fits', {"a": [1]}), ("```python\nx\n```\n```json\n[3]\n```", [3]), ("", None), (None, None), ("none", None)])
def test_repaired_json(reply, value):
    assert enrich.repaired_json(reply) == value


def test_markup():
    assert [(s["title"], s["text"]) for s in documents.split_markdown("pre\n# A\nx\n#### d\n## B\n\n### C\ny")] == [("", "pre"), ("A", "x\n#### d"), ("C", "y")]
    assert [(s["title"], s["text"]) for s in documents.split_rst("pre\nTitle\n=====\nbody\n--\nmore")] == [("", "pre"), ("Title", "body\n--\nmore")]
    title, found = documents.extract_page("<title> T </title><nav>no</nav><p>intro</p><h2>H</h2><p>a &amp; b</p><script>x</script>")
    assert title == "T" and [(s["title"], s["text"]) for s in found] == [("T", "intro"), ("H", "a & b")]
    assert documents.extract_page(None) == ("", []) and documents.extract_page("<p")[1] in ([], documents.extract_page("<p")[1])
    code = documents.extract_code("a.py", b"import os\n@x\ndef f():\n    pass\nclass C: pass\n")
    assert [s["title"] for s in code] == ["f", "C"] and code[0]["text"] == "# a.py\nimport os\n\n@x\ndef f():\n    pass"
    assert len(documents.extract_code("a.py", b"def (\n\n\n" + b"y" * 30)) == 1


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.js").write_text("y" * 50)
    with zipfile.ZipFile(tmp_path / "d.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="u"><manifest><item id="i" href="x.html"/></manifest><spine><itemref idref="i"/></spine></package>')
        z.writestr("o/x.html", "<h1>One</h1><p>" + "word " * 20 + "</p><h2>Two</h2><p>short</p>")
    (tmp_path / "e.epub").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "b.pdf", "d.epub", "e.epub"}
    assert got["a.md"].sections[0].title == "A" and [s.title for s in got["d.epub"].sections] == ["One"]
    assert got["b.pdf"].error and got["e.epub"].error and not got["d.epub"].error


def test_subtitles(spark, tmp_path):
    segments = [(0.0, 1.25, "hello there"), (3661.5, 3662.0, "again")]
    assert media.parse_srt(media.format_srt(segments)) == segments
    assert media.parse_txt(media.format_txt([(1.0, 65.0, "x y")])) == [(1.0, 65.0, "x y")]
    assert media.parse_srt("1\nbad\ntext\n\n2\n00:00:01,000 --> 00:00:02,000\na\nb\n") == [(1.0, 2.0, "a b")] and media.parse_srt(None) == []
    (tmp_path / "e1.srt").write_text(media.format_srt(segments))
    (tmp_path / "e2.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\na\nb\n")
    got = [(r.episode_num, r.start, r.end, r.text) for r in media.read_srt(spark, str(tmp_path)).orderBy("path", "start").collect()]
    assert got == [(1, 0.0, 1.25, "hello there"), (1, 3661.5, 3662.0, "again"), (2, 1.0, 2.0, "a b")]


def test_archive(spark, tmp_path):
    archive.save(str(tmp_path), "c", {"chunks.json": [{"id": "1", "text": "a"}], "extracted.md": "# x"})
    archive.save(str(tmp_path), "c", {"chunks.json": [{"id": "2", "text": "b"}]})
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "chunks.json").write_text("broken")
    assert [tuple(r) for r in archive.read_chunks(spark, str(tmp_path), "id string, text string").collect()] == [("c", "2", "b")]
    with pytest.raises(TypeError):
        archive.save(str(tmp_path), "c", {"chunks.json": {1, 2}})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c", "d"] and json.loads((tmp_path / "c" / "chunks.json").read_text())[0]["id"] == "2"


def test_stream_of_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = sessions.session_windows(stream).writeStream.format("memory").queryName("found").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.user_id, r.events) for r in spark.table("found").collect()) == [(1, 1), (1, 2), (2, 1)]
    seen = []
    sessions.ingest(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "checkpoint")).awaitTermination()
    assert sum(seen) == 4
