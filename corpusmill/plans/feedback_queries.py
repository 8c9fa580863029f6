"""Queries of sessions, messages, ratings and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import feedback
from corpusmill.operators import retrieval as R
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval_queries import Q, RATINGS, TERMS, WILSON, queries
from corpusmill.plans.tables import CHUNKS, chunks
from corpusmill.session import table

LATEST_SESSIONS = "ls AS (SELECT * FROM chat_sessions QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, title DESC NULLS LAST) = 1)"
LATEST_MESSAGES = "lm AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST, created_at DESC NULLS LAST, content DESC NULLS LAST, session_id DESC NULLS LAST, role DESC NULLS LAST) = 1)"


def latest_messages(spark, sf_dir):
    return feedback.latest(table(spark, sf_dir, "messages"), ["id"], ["received_at", "created_at", "content", "session_id", "role"])


@query(f"WITH {RATINGS} SELECT chunk_id, round({WILSON.format(a='(fetches + 3 * explicit_up)', b='(ignores + 3 * explicit_down)')}, 6) AS score FROM rat")
def wilson_score(spark, sf_dir):
    r = feedback.chunk_ratings(table(spark, sf_dir, "interactions"))
    return r.select("chunk_id", F.round(R.wilson(F.col("fetches") + 3 * F.col("explicit_up"), F.col("ignores") + 3 * F.col("explicit_down")), 6).alias("score"))


@query(f"WITH {RATINGS} SELECT * FROM rat")
def chunk_ratings(spark, sf_dir):
    return feedback.chunk_ratings(table(spark, sf_dir, "interactions"))


@query(f"WITH {RATINGS} SELECT chunk_id, (fetches + 3 * explicit_up) - (ignores + 3 * explicit_down) AS net FROM rat ORDER BY net DESC, chunk_id LIMIT 10")
def top_chunks(spark, sf_dir):
    r = feedback.chunk_ratings(table(spark, sf_dir, "interactions"))
    return r.select("chunk_id", feedback.net_score().alias("net")).orderBy(F.col("net").desc(), "chunk_id").limit(10)


@query("SELECT query, count(*) AS searches FROM (SELECT DISTINCT id, session_id, occurred_at, query FROM interactions WHERE action IN ('search', 'search_deep') AND query IS NOT NULL) GROUP BY 1 ORDER BY searches DESC, query LIMIT 10")
def top_queries(spark, sf_dir):
    return feedback.top_queries(table(spark, sf_dir, "interactions"))


@query(f"WITH {RATINGS} SELECT (SELECT count(DISTINCT id) FROM interactions) AS interactions, (SELECT count(DISTINCT session_id) FROM interactions) AS sessions, (SELECT count(*) FROM rat) AS rated_chunks")
def interaction_stats(spark, sf_dir):
    log = table(spark, sf_dir, "interactions")
    rated = feedback.chunk_ratings(log).agg(F.count("*").alias("rated_chunks"))
    return log.agg(F.countDistinct("id").alias("interactions"), F.countDistinct("session_id").alias("sessions")).join(F.broadcast(rated))  # one row


@query(f"WITH {LATEST_SESSIONS}, c AS (SELECT session_id, count(*) AS n FROM (SELECT DISTINCT id, session_id FROM messages) GROUP BY 1) SELECT id, title, epoch_us(updated_at) AS updated_us, coalesce(n, 0) AS messages FROM ls LEFT JOIN c ON c.session_id = ls.id")
def list_sessions(spark, sf_dir):
    found = feedback.list_sessions(table(spark, sf_dir, "chat_sessions"), table(spark, sf_dir, "messages"))
    return found.select("id", "title", F.unix_micros("updated_at").alias("updated_us"), "messages")


@query(f"WITH {LATEST_SESSIONS}, {LATEST_MESSAGES} SELECT ls.id AS session_id, lm.id AS message_id, lm.role, md5(lm.content) AS content_md5 FROM ls LEFT JOIN lm ON lm.session_id = ls.id")
def get_session(spark, sf_dir):
    """Every session with its messages, one row each; a session without messages has one row."""
    s = feedback.latest(table(spark, sf_dir, "chat_sessions"), ["id"], ["updated_at", "created_at", "title"]).select(F.col("id").alias("session_id"))
    m = latest_messages(spark, sf_dir).select("session_id", F.col("id").alias("message_id"), "role", F.md5("content").alias("content_md5"))
    return s.join(m, "session_id", "left")


@query(f"""WITH {Q}, {LATEST_MESSAGES}, d AS (SELECT id, {TERMS.format('content')} AS t FROM lm WHERE content IS NOT NULL),
tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), p AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT term, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM p JOIN f USING (term), tot),
s AS (SELECT qid, id, round(sum(w), 6) AS score FROM (SELECT DISTINCT qid, unnest({TERMS.format('query')}) AS term FROM q) JOIN w USING (term) GROUP BY ALL)
SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INTEGER AS rank FROM s QUALIFY rank <= 20""")
def search_messages(spark, sf_dir):
    return R.bm25(latest_messages(spark, sf_dir), "id", "content", queries(spark, sf_dir), "qid", "query", 20)


@query(f"WITH {Q}, {LATEST_MESSAGES} SELECT qid, id FROM q JOIN lm ON contains(lower(content), lower(q.query))")
def search_messages_plain(spark, sf_dir):
    """Where the index can't be used: messages that contain the query, whatever the case."""
    return R.contains_search(latest_messages(spark, sf_dir), "id", "content", queries(spark, sf_dir), "qid", "query")


@query("SELECT session_id, action, query AS value, epoch_us(occurred_at) AS updated_us FROM interactions QUALIFY row_number() OVER (PARTITION BY session_id, action ORDER BY occurred_at DESC NULLS LAST, id DESC, query DESC NULLS LAST) = 1")
def settings_upsert(spark, sf_dir):
    """The last value written under each key."""
    last = feedback.latest(table(spark, sf_dir, "interactions").select("session_id", "action", "query", "occurred_at", "id"), ["session_id", "action"], ["occurred_at", "id", "query"])
    return last.select("session_id", "action", F.col("query").alias("value"), F.unix_micros("occurred_at").alias("updated_us"))


LOG = "g AS (SELECT collection, file_path, CASE WHEN sections IS NULL THEN 'started' WHEN len(sections) = 0 THEN 'failed' ELSE 'done' END AS status, coalesce(len(sections), 0)::INTEGER AS chunks, epoch_us(extracted_at) AS at_us FROM extracted_documents QUALIFY row_number() OVER (PARTITION BY collection, file_path ORDER BY extracted_at DESC NULLS LAST, extract_id DESC) = 1)"


def _ingests(spark, sf_dir):
    last = feedback.latest(table(spark, sf_dir, "extracted_documents"), ["collection", "file_path"], ["extracted_at", "extract_id"])
    status = F.when(F.col("sections").isNull(), "started").when(F.size("sections") == 0, "failed").otherwise("done")
    return last.select("collection", "file_path", status.alias("status"), F.when(F.col("sections").isNull(), 0).otherwise(F.size("sections")).alias("chunks"), F.unix_micros("extracted_at").alias("at_us"))


@query(f"WITH {LOG} SELECT * FROM g")
def ingest_log(spark, sf_dir):
    return _ingests(spark, sf_dir)


@query(f"WITH {LOG} SELECT * FROM g WHERE status NOT IN ('done', 'failed')")
def resumable_ingests(spark, sf_dir):
    return _ingests(spark, sf_dir).where("status NOT IN ('done', 'failed')")


@query(f"""SELECT CASE WHEN topic = '' THEN 'uncategorized' ELSE topic END AS topic, count(DISTINCT collection) AS collections, count(*) AS chunks, count(DISTINCT collection || '#' || episode_num) AS episodes FROM {CHUNKS} GROUP BY 1""")
def intro_overview(spark, sf_dir):
    topic = F.when(F.col("topic") == "", "uncategorized").otherwise(F.col("topic"))
    per = chunks(spark, sf_dir).groupBy(topic.alias("topic"), "collection", "episode_num").agg(F.count("*").alias("n"))  # small before the distinct counts
    return per.groupBy("topic").agg(F.countDistinct("collection").alias("collections"), F.sum("n").alias("chunks"), F.countDistinct("collection", "episode_num").alias("episodes"))


@query(f"SELECT tag, count(*) AS chunks FROM (SELECT unnest(list_distinct(list_filter(list_transform(string_split(concept_tags, ','), lambda x: lower(trim(x))), lambda x: x <> ''))) AS tag FROM {CHUNKS}) GROUP BY 1 ORDER BY chunks DESC, tag LIMIT 15")
def tag_counts(spark, sf_dir):
    tags = chunks(spark, sf_dir).select(F.explode(F.array_distinct(T.tag_list(F.col("concept_tags")))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("chunks")).orderBy(F.col("chunks").desc(), "tag").limit(15)


@query(f"""WITH c AS (SELECT topic, subtopic, collection, collection_display, count(DISTINCT episode_num || chr(0) || episode_title) AS episode_count FROM {CHUNKS} GROUP BY ALL),
s AS (SELECT collection, arg_min(text, extract_id) AS overview, count(*)::INTEGER AS parts FROM (SELECT extract_id, collection, sections[1].text AS text FROM extracted_documents WHERE len(sections) > 0 AND sections[1].text IS NOT NULL) GROUP BY 1)
SELECT c.*, coalesce(md5(s.overview), '') AS overview_md5, coalesce(s.parts, 0) AS parts FROM c LEFT JOIN s ON s.collection = c.collection""")
def collection_details(spark, sf_dir):
    """Every collection with what its archive says of it: here, the first section of its first extracted document as overview."""
    from corpusmill.operators import store

    c = store.list_collections(chunks(spark, sf_dir)).drop("episodes")
    d = table(spark, sf_dir, "extracted_documents").where(F.size("sections") > 0).select("collection", "extract_id", F.col("sections")[0]["text"].alias("text")).where("text IS NOT NULL")
    s = d.groupBy("collection").agg(F.min_by("text", "extract_id").alias("overview"), F.count("*").cast("int").alias("parts"))
    return c.join(s, "collection", "left").select("topic", "subtopic", "collection", "collection_display", "episode_count", F.coalesce(F.md5("overview"), F.lit("")).alias("overview_md5"), F.coalesce("parts", F.lit(0)).alias("parts"))


@query(f"""WITH g AS (SELECT id, session_id, query, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at, id) AS n, count(*) OVER (PARTITION BY session_id) AS searches FROM (SELECT DISTINCT id, session_id, occurred_at, query FROM interactions WHERE query IS NOT NULL))
SELECT session_id, substr(query, 1, 80) AS title, searches FROM g WHERE n = 1""")
def session_titles(spark, sf_dir):
    """A title for each session of the log: the first 80 characters of what it asked first."""
    g = table(spark, sf_dir, "interactions").where("query IS NOT NULL").select("id", "session_id", "occurred_at", "query").distinct()
    first = g.groupBy("session_id").agg(F.min_by("query", F.struct("occurred_at", "id")).alias("q"), F.count("*").alias("searches"))
    return first.select("session_id", F.substring("q", 1, 80).alias("title"), "searches")
