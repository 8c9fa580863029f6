"""Queries of text functions, sections and chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunking
from corpusmill.plans.registry import query
from corpusmill.plans.tables import CHUNKS, chunks
from corpusmill.session import table

STRIP = r"regexp_replace({}, '^[ \t\n\f\r\x0B]+|[ \t\n\f\r\x0B]+$', '', 'g')"
WORDS = r"list_filter(string_split_regex({}, '[ \t\n\f\r\x0B]+'), lambda w: w <> '')"


TITLE = r"regexp_extract(text, '(?is)<title[^>]*>(.*?)</title\s*>', 1)"


def sql_slug(c: str, most: int = 30) -> str:
    return f"rtrim(substr(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_'), 1, {most}), '_')"


@query("SELECT chunk_key, (length(text) // 4)::INTEGER AS tokens FROM chunks WHERE text IS NOT NULL")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("chunk_key", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT chunk_key, substr(sha256(text), 1, 16) AS hash, coalesce(content_hash = substr(sha256(text), 1, 16), false) AS fresh FROM chunks WHERE text IS NOT NULL")
def content_hash(spark, sf_dir):
    h = T.content_hash(F.col("text"))
    return table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("chunk_key", h.alias("hash"), F.coalesce(F.col("content_hash") == h, F.lit(False)).alias("fresh"))


@query(f"SELECT chunk_key, {sql_slug('collection_display')} AS collection_slug, {sql_slug('title', 20)} AS title_slug FROM {CHUNKS}")
def slug(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_key", T.slug(F.col("collection_display")).alias("collection_slug"), T.slug(F.col("title"), 20).alias("title_slug"))


@query(rf"""SELECT doc_id, substr(regexp_replace({STRIP.format(r'''regexp_replace(title, '[<>:"/\\|?*\x00-\x1f]', '', 'g')''')}, '[ \t\n\f\r\x0B]+', '_', 'g'), 1, 80) AS file_name FROM documents WHERE title IS NOT NULL""")
def sanitize(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("title IS NOT NULL").select("doc_id", T.sanitize(F.col("title")).alias("file_name"))


@query(f"SELECT chunk_key, lpad((start_sec // 60)::VARCHAR, greatest(2, length((start_sec // 60)::VARCHAR))::INTEGER, '0') || ':' || lpad((start_sec % 60)::VARCHAR, 2, '0') AS label FROM {CHUNKS}")
def fmt_timestamp(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_key", T.fmt_timestamp(F.col("start_sec")).alias("label"))


@query(
    f"""SELECT chunk_key, CASE WHEN start_sec > 0 AND (contains(url, 'youtube.com') OR contains(url, 'youtu.be') OR contains(url, 'bilibili.com'))
    THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 't=' || start_sec ELSE url END AS link FROM {CHUNKS}"""
)
def deep_link(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_key", T.deep_link(F.col("url"), F.col("start_sec")).alias("link"))


def _pad(c: str, n: int) -> str:
    return f"lpad(({c})::VARCHAR, greatest({n}, length(({c})::VARCHAR))::INTEGER, '0')"


@query(
    f"""
WITH c AS (SELECT *, {sql_slug('collection')} AS base, {_pad('chunk_index', 4)} AS nr, 's' || {_pad('chunk_index', 3)} AS nth,
    '_L' || line_start || '-' || line_end AS span, coalesce(nullif(chapter, ''), section_heading) AS ch, coalesce(nullif(section_heading, ''), chapter) AS sec FROM {CHUNKS})
SELECT chunk_key, CASE source_type
  WHEN 'epub' THEN base || '_ch_' || CASE WHEN ch = '' THEN nth ELSE {sql_slug('ch', 20)} END || '_' || nr
  WHEN 'pdf' THEN base || '_' || coalesce(nullif(CASE WHEN sec IN ('', '(untitled)', '(preamble)') THEN '' ELSE {sql_slug('sec', 20)} END, ''), CASE WHEN page_num > 0 THEN 'p' || page_num END, nth)
     || '_' || nr || CASE WHEN line_start > 0 THEN span ELSE '' END
  WHEN 'code' THEN base || '_' || {sql_slug("translate(file_path, '/.', '__')", 40)} || span
  WHEN 'web' THEN base || '_' || CASE WHEN section_heading = '' THEN nth ELSE {sql_slug('section_heading', 20)} END || '_' || nr
  ELSE CASE WHEN source_type IN ('video', 'audio') THEN base || '_' || coalesce(nullif({sql_slug('episode_title', 20)}, ''), 'ep' || {_pad('episode_num', 3)})
     || '_t' || {_pad('start_sec // 60', 2)} || 'm' || {_pad('start_sec % 60', 2)} || 's' ELSE base || '_' || nr END END AS built_id FROM c
"""
)
def chunk_id(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_key", T.chunk_id(F.col("chunk_index")).alias("built_id"))


def _chunk_sql(step: int) -> str:
    return rf"""
WITH d AS (SELECT doc_id, {STRIP.format('text')} AS t, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, 0 AS i, t AS text FROM d WHERE len(w) BETWEEN 1 AND 384
  UNION ALL SELECT doc_id, (s // {step})::INTEGER, array_to_string(w[s + 1 : s + 384], ' ') FROM (SELECT *, unnest(range(0, len(w), {step})) AS s FROM d WHERE len(w) > 384))
SELECT doc_id, i AS chunk_index, text FROM c"""


@query(_chunk_sql(384))
def chunk_text(spark, sf_dir):
    return chunking.chunk_text(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(_chunk_sql(384 - 48))
def chunk_text_overlap(spark, sf_dir):
    return chunking.chunk_text(table(spark, sf_dir, "documents"), "text", "doc_id", overlap=64)


@query(
    rf"""
WITH RECURSIVE s AS (SELECT extract_id, n, {STRIP.format("coalesce(sections[n].title, '')")} AS title, {STRIP.format("coalesce(sections[n].text, '')")} AS body,
    coalesce(sections[n].page_num, 0) AS page, coalesce(sections[n].chapter, '') AS chapter
  FROM (SELECT extract_id, sections, unnest(range(1, len(sections) + 1)) AS n FROM extracted_documents)),
b AS (SELECT *, CASE WHEN title <> '' THEN title || chr(10) || body ELSE body END AS block, row_number() OVER (PARTITION BY extract_id ORDER BY n) AS k FROM s WHERE body <> ''),
w AS (SELECT *, len({WORDS.format('block')}) AS words FROM b),
f AS (SELECT extract_id, k, 1 AS grp, words AS filled, length(block) AS largest, title AS heading, page, chapter, block AS txt FROM w WHERE k = 1
  UNION ALL SELECT w.extract_id, w.k, CASE WHEN filled >= 128 THEN grp + 1 ELSE grp END, CASE WHEN filled >= 128 THEN words ELSE filled + words END,
    CASE WHEN filled >= 128 THEN length(block) ELSE greatest(largest, length(block)) END,
    CASE WHEN filled >= 128 THEN title WHEN length(block) > largest AND title <> '' THEN title ELSE heading END,
    CASE WHEN filled >= 128 OR length(block) > largest THEN w.page ELSE f.page END, CASE WHEN filled >= 128 OR length(block) > largest THEN w.chapter ELSE f.chapter END,
    CASE WHEN filled >= 128 THEN block ELSE txt || chr(10) || block END
  FROM f JOIN w ON w.extract_id = f.extract_id AND w.k = f.k + 1),
g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY extract_id, grp ORDER BY k DESC) = 1),
x AS (SELECT *, {WORDS.format('txt')} AS ws FROM g),
p AS (SELECT extract_id, grp, 0 AS part, txt AS text, heading, page, chapter FROM x WHERE len(ws) <= 384
  UNION ALL SELECT extract_id, grp, o, array_to_string(ws[o + 1 : o + 384], ' '), heading, page, chapter FROM (SELECT *, unnest(range(0, len(ws), 384)) AS o FROM x WHERE len(ws) > 384))
SELECT extract_id, (row_number() OVER (PARTITION BY extract_id ORDER BY grp, part) - 1)::INTEGER AS chunk_index, text, heading AS section_heading, page AS page_num, chapter FROM p
"""
)
def chunk_sections(spark, sf_dir):
    return chunking.chunk_sections(table(spark, sf_dir, "extracted_documents"), "extract_id", "sections")


@query()
def chunk_segments(spark, sf_dir):
    """Windows of 90 seconds over the timed chunks of each episode."""
    timed = chunks(spark, sf_dir).where((F.col("end_sec") > F.col("start_sec")) & F.col("source_type").isin("video", "audio"))
    return chunking.chunk_segments(timed, ["collection", "episode_num"], "start_sec", "end_sec", "text", ["chunk_key"])


@query(
    r"""
WITH d AS (SELECT doc_id, list_concat([''], regexp_extract_all(text, '(?m)^#{1,3}[ \t\n\f\r]+(.*)', 1)) AS titles,
    string_split_regex(text, '(?m)^#{1,3}[ \t\n\f\r]+.*') AS bodies FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, n, """
    + STRIP.format("titles[n]")
    + " AS title, "
    + STRIP.format("bodies[n]")
    + """ AS body FROM (SELECT *, unnest(range(1, len(bodies) + 1)) AS n FROM d))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS section_no, title, body AS text FROM s WHERE body <> ''
"""
)
def split_markdown(spark, sf_dir):
    found = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(T.markdown_sections(F.col("text"))).alias("section_no", "s"))
    return found.select("doc_id", "section_no", "s.title", "s.text")


@query(
    rf"""
WITH t AS (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL UNION SELECT DISTINCT section_heading FROM chunks WHERE section_heading IS NOT NULL)
SELECT title, length(title) BETWEEN 1 AND 80 AND NOT regexp_matches(title, '(?i)^\d+$|^https?://|^[/\\]|\.{{3,}}|^\w+\.\w+\(|^import |^from |^def |^class ')
  AND NOT (ends_with(title, '.') AND contains(title, ' ') AND len({WORDS.format('title')}) > 5) AS valid FROM t
"""
)
def valid_heading(spark, sf_dir):
    titles = table(spark, sf_dir, "documents").select("title").unionByName(table(spark, sf_dir, "chunks").select(F.col("section_heading").alias("title")))
    return titles.where("title IS NOT NULL").distinct().select("title", T.valid_heading(F.col("title")).alias("valid"))


@query(
    """
WITH s AS (SELECT extract_id, n, sections[n].title AS title, sections[n].text AS text FROM (SELECT extract_id, sections, unnest(range(1, len(sections) + 1)) AS n FROM extracted_documents))
SELECT extract_id, (n - 1)::INTEGER AS section_no, title FROM s WHERE text IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY extract_id, title ORDER BY length(text) DESC, n) = 1
"""
)
def keep_longest_dup(spark, sf_dir):
    s = table(spark, sf_dir, "extracted_documents").select("extract_id", F.posexplode("sections").alias("section_no", "s")).select("extract_id", "section_no", "s.title", "s.text").where("text IS NOT NULL")
    w = Window.partitionBy("extract_id", "title").orderBy(F.length("text").desc(), "section_no")
    return s.withColumn("n", F.row_number().over(w)).where("n = 1").select("extract_id", "section_no", "title")


def _html_sql() -> str:
    s = "text"
    for tag in ("script", "style", "nav", "footer", "header"):
        s = f"regexp_replace({s}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    s = rf"regexp_replace(regexp_replace({s}, '(?s)<!--.*?-->', '', 'g'), '(?s)</?[a-zA-Z][^>]*>', chr(10), 'g')"
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        s = f"replace({s}, '{entity}', '{plain}')"
    return s


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split({_html_sql()}, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> ''), chr(10)) AS plain FROM documents WHERE text IS NOT NULL")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.html_text(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, {STRIP.format(TITLE)} AS title FROM documents WHERE text IS NOT NULL")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.html_title(F.col("text")).alias("title"))


@query(
    f"""
WITH n AS (SELECT collection, episode_num, start_sec, end_sec, row_number() OVER (PARTITION BY collection, episode_num ORDER BY start_sec, end_sec, chunk_key) AS k
  FROM {CHUNKS} WHERE end_sec > start_sec)
SELECT collection, episode_num, ((k - 1) // 10)::INTEGER AS grp, count(*) AS segments, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM n GROUP BY ALL
"""
)
def segment_groups_of_10(spark, sf_dir):
    w = Window.partitionBy("collection", "episode_num").orderBy("start_sec", "end_sec", "chunk_key")
    rows = chunks(spark, sf_dir).where("end_sec > start_sec").select("collection", "episode_num", "start_sec", "end_sec", F.floor((F.row_number().over(w) - 1) / 10).cast("int").alias("grp"))
    return rows.groupBy("collection", "episode_num", "grp").agg(F.count("*").alias("segments"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))


def _ext_sql() -> str:
    whens = " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in e.split())}) THEN '{k}'" for k, e in T.EXTENSIONS.items())
    return f"SELECT extract_id, CASE {whens} ELSE 'text' END AS detected FROM (SELECT extract_id, lower(regexp_extract(file_path, '[^/]\\.([^./]*)$', 1)) AS ext FROM extracted_documents WHERE file_path IS NOT NULL)"


@query(_ext_sql())
def detect_source_type(spark, sf_dir):
    return table(spark, sf_dir, "extracted_documents").where("file_path IS NOT NULL").select("extract_id", T.source_type_of(F.col("file_path")).alias("detected"))


@query(
    f"""
WITH c AS (SELECT chunk_key, list_distinct({WORDS.format('lower(text)')}) AS w, lead(list_distinct({WORDS.format('lower(text)')})) OVER (PARTITION BY collection, episode_num ORDER BY chunk_index, chunk_key) AS v FROM {CHUNKS})
SELECT chunk_key, round(len(list_intersect(w, v))::DOUBLE / len(v), 6) AS overlap FROM c WHERE len(v) > 0
"""
)
def word_overlap(spark, sf_dir):
    w = Window.partitionBy("collection", "episode_num").orderBy("chunk_index", "chunk_key")
    c = chunks(spark, sf_dir).select("chunk_key", F.array_distinct(T.words(F.lower("text"))).alias("w"), "collection", "episode_num", "chunk_index")
    c = c.withColumn("v", F.lead("w").over(w)).where(F.size("v") > 0)
    return c.select("chunk_key", F.round(F.size(F.array_intersect("w", "v")) / F.size("v"), 6).alias("overlap"))


@query(
    """
WITH a AS (SELECT DISTINCT id, coalesce(from_json(chunk_ids_shown, '["VARCHAR"]'), []) AS s, coalesce(from_json(chunk_ids_fetched, '["VARCHAR"]'), []) AS f, coalesce(from_json(chunk_ids_ignored, '["VARCHAR"]'), []) AS g FROM interactions)
SELECT id, array_to_string(list_sort(list_distinct(list_concat(s, f))), '|') AS either, array_to_string(list_sort(list_distinct(list_filter(s, lambda x: NOT list_contains(f, x)))), '|') AS unfetched,
  array_to_string(list_sort(list_distinct(list_filter(s, lambda x: list_contains(g, x)))), '|') AS ignored FROM a
"""
)
def array_set_ops(spark, sf_dir):
    ids = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    a = table(spark, sf_dir, "interactions").select("id", ids("chunk_ids_shown").alias("s"), ids("chunk_ids_fetched").alias("f"), ids("chunk_ids_ignored").alias("g")).distinct()
    joined = lambda c, name: F.array_join(F.array_sort(c), "|").alias(name)
    return a.select("id", joined(F.array_union("s", "f"), "either"), joined(F.array_except("s", "f"), "unfetched"), joined(F.array_intersect("s", "g"), "ignored"))


@query(f"SELECT chunk_key, len({WORDS.format('text')})::INTEGER AS words FROM {CHUNKS} WHERE len({WORDS.format('text')}) >= 15")
def enrichable_filter(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_key", T.word_count(F.col("text")).alias("words")).where("words >= 15")


@query(
    """
SELECT vec_id, i::INTEGER - 1 AS place, round(embedding[i]::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-9), 5) + 0.0 AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
"""
)
def l2_normalize(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) + 1e-9
    e = table(spark, sf_dir, "embeddings").select("vec_id", norm.alias("norm"), F.posexplode("embedding").alias("place", "x"))
    return e.select("vec_id", "place", F.round(F.col("x").cast("double") / F.col("norm"), 5).alias("value"))


@query()
def pages_extract(spark, sf_dir):
    """Every document read as a web page: its title, and how many sections and words they have."""
    from corpusmill.sources import documents

    found = documents.pages(table(spark, sf_dir, "documents"), "doc_id", "text")
    words = F.aggregate("sections", F.lit(0), lambda a, s: a + T.word_count(s["text"]))
    return found.select(F.col("key").alias("doc_id"), "title", F.size("sections").alias("sections"), words.alias("words"))


@query()
def web_sections(spark, sf_dir):
    """The sections of every document as a web page, under its own title."""
    from corpusmill.sources import documents

    found = documents.pages(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), F.posexplode("sections").alias("section_no", "s")).select("doc_id", "section_no", "s.title", "s.text")


@query(
    """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS events FROM s GROUP BY user_id, n
"""
)
def event_sessions(spark, sf_dir):
    """Sessions of the event log, by gaps of half an hour."""
    from corpusmill.streaming import sessions

    found = sessions.session_windows(table(spark, sf_dir, "events"))
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


PAGED = "list_reduce(list_transform(generate_series(1, len(sections)), lambda i: chr(10) || '<!--PAGE:' || coalesce(sections[i].page_num, 0) || '-->' || chr(10) || chr(10) || '## Part ' || i || chr(10) || coalesce(sections[i].text, '')), lambda a, b: a || b)"


def _paged(spark, sf_dir):
    """Extracted documents as markdown of pages: a marker and a header before each section's text."""
    part = F.transform("sections", lambda s, i: F.concat(F.lit("\n<!--PAGE:"), F.coalesce(s["page_num"], F.lit(0)).cast("string"), F.lit("-->\n\n## Part "), (i + 1).cast("string"), F.lit("\n"), F.coalesce(s["text"], F.lit(""))))
    return table(spark, sf_dir, "extracted_documents").where(F.size("sections") > 0).select("extract_id", F.array_join(part, "").alias("markdown"))


@query(rf"""WITH m AS (SELECT extract_id, {PAGED} AS md FROM extracted_documents WHERE len(sections) > 0),
l AS (SELECT extract_id, md, unnest(range(1, len(string_split(md, chr(10))) + 1)) AS n, string_split(md, chr(10)) AS ls FROM m),
k AS (SELECT extract_id, n, ls[n] AS line, CASE WHEN regexp_matches(ls[n], '^#{{1,3}}[ 	]+.') THEN 1 ELSE 0 END AS head, try_cast(regexp_extract(ls[n], '<!--PAGE:(\d+)-->', 1) AS INTEGER) AS page FROM l),
w AS (SELECT *, sum(head) OVER (PARTITION BY extract_id ORDER BY n) AS sec, last_value(page IGNORE NULLS) OVER (PARTITION BY extract_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS pg FROM k),
s AS (SELECT extract_id, sec, max(CASE WHEN head = 1 THEN trim(regexp_replace(line, '^#+[ 	]+', '')) END) AS title, max(CASE WHEN head = 1 THEN pg END) AS page_num,
  {STRIP.format("regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (head = 0), ''), '<!--PAGE:[0-9]+-->', '', 'g')")} AS body FROM w GROUP BY ALL)
SELECT extract_id, (row_number() OVER (PARTITION BY extract_id ORDER BY sec) - 1)::INTEGER AS section_no, title, page_num, md5(body) AS body_md5 FROM s WHERE body <> '' AND sec > 0""")
def pdf_sections(spark, sf_dir):
    """Sections of paged markdown, with the page that each header stands on."""
    from corpusmill.sources import pdf

    found = pdf.sections(_paged(spark, sf_dir), "extract_id", "markdown", pdf.header_sections)
    return found.select("extract_id", "section_no", "title", "page_num", F.md5("text").alias("body_md5"))


@query(r"""WITH m AS (SELECT extract_id, sections, unnest(range(1, len(sections) + 1)) AS i FROM extracted_documents WHERE len(sections) >= 3),
s AS (SELECT extract_id, i, 'Chapter ' || chr((65 + (i % 2))::INTEGER) || '. Title' AS title, trim(coalesce(sections[i].text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY extract_id, title ORDER BY length(body) DESC, i) AS n FROM s WHERE length(body) > 200)
SELECT extract_id, (row_number() OVER (PARTITION BY extract_id ORDER BY i) - 1)::INTEGER AS section_no, title, md5(body) AS body_md5 FROM r WHERE n = 1""")
def chapter_sections(spark, sf_dir):
    """Sections by titles of chapters, of which two alternate in each document; of those with one title the longest stays."""
    from corpusmill.sources import pdf

    part = F.transform("sections", lambda s, i: F.concat(F.lit("Chapter "), F.chr(F.lit(65) + F.pmod(i + 1, F.lit(2))), F.lit(". Title\n"), F.coalesce(s["text"], F.lit("")), F.lit("\n")))
    d = table(spark, sf_dir, "extracted_documents").where(F.size("sections") >= 3).select("extract_id", F.array_join(part, "").alias("markdown"))
    return pdf.sections(d, "extract_id", "markdown", pdf.chapter_sections).select("extract_id", "section_no", "title", F.md5("text").alias("body_md5"))
