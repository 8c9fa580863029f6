"""Queries of the chunk table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import store
from corpusmill.plans.registry import query
from corpusmill.plans.tables import CHUNKS, chunks
from corpusmill.session import table

HOT = "open_studio_archive"


@query(f"SELECT {', '.join(store.METADATA)} FROM {CHUNKS} WHERE collection = '{HOT}'")
def get_all_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).where(F.col("collection") == HOT).select(*store.METADATA)


@query("SELECT count(*) AS chunks FROM chunks")
def chunk_count(spark, sf_dir):
    return table(spark, sf_dir, "chunks").agg(F.count("*").alias("chunks"))


@query(
    f"""
SELECT topic, subtopic, collection, collection_display, count(*) AS episode_count, string_agg(episode_num || ':' || episode_title, '|' ORDER BY episode_num, episode_title) AS episodes
FROM (SELECT DISTINCT topic, subtopic, collection, collection_display, episode_num, episode_title FROM {CHUNKS}) GROUP BY ALL
"""
)
def list_collections(spark, sf_dir):
    return store.list_collections(chunks(spark, sf_dir))


@query(
    f"""
WITH c AS (SELECT *, coalesce(nullif(section_heading, ''), chapter) AS heading FROM {CHUNKS}),
f AS (SELECT *, CASE WHEN lag(heading) OVER w IS NOT DISTINCT FROM heading THEN 0 ELSE 1 END AS new, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY collection ORDER BY episode_num, chunk_index, chunk_key)),
r AS (SELECT *, sum(new) OVER (PARTITION BY collection ORDER BY rn) AS run FROM f)
SELECT collection, arg_min(episode_num, rn) AS episode_num, arg_min(chunk_index, rn) AS chunk_index, arg_min(heading, rn) AS heading, count(*) AS chunk_count, sum(length(text) // 4)::BIGINT AS token_count,
  arg_min(id, rn) AS first_chunk_id, arg_min(source_type, rn) AS source_type FROM r GROUP BY collection, run
"""
)
def get_toc(spark, sf_dir):
    return store.table_of_contents(chunks(spark, sf_dir))


def _neighbors_sql(at: str, reach: int, kind: str) -> str:
    return f"""SELECT t.chunk_key, r.chunk_key AS neighbor_key, r.{at} AS place FROM {CHUNKS} t JOIN {CHUNKS} r
ON t.collection = r.collection AND t.episode_num = r.episode_num AND r.{at} BETWEEN greatest(0, t.{at} - {reach}) AND t.{at} + {reach} WHERE t.chunk_key % 50 = 0 AND {kind}"""


@query(_neighbors_sql("start_sec", 150, "t.end_sec > 0"))
def neighbors_temporal(spark, sf_dir):
    c = chunks(spark, sf_dir).select("chunk_key", "collection", "episode_num", "start_sec", "end_sec")
    found = store.neighbors(c.where("chunk_key % 50 = 0 AND end_sec > 0"), c, "start_sec", 150)
    return found.select("chunk_key", F.col("r_chunk_key").alias("neighbor_key"), F.col("r_start_sec").alias("place"))


@query(_neighbors_sql("chunk_index", 2, "t.end_sec = 0"))
def neighbors_index(spark, sf_dir):
    c = chunks(spark, sf_dir).select("chunk_key", "collection", "episode_num", "chunk_index", "end_sec")
    found = store.neighbors(c.where("chunk_key % 50 = 0 AND end_sec = 0"), c, "chunk_index", 2)
    return found.select("chunk_key", F.col("r_chunk_key").alias("neighbor_key"), F.col("r_chunk_index").alias("place"))


@query(
    """SELECT result_id FROM search_results s WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.text IS NOT NULL AND substr(sha256(c.text), 1, 16) = substr(sha256(s.text), 1, 16)
    AND c.collection = s.collection AND c.episode_num <> s.episode_num)"""
)
def add_chunks_dedup(spark, sf_dir):
    return store.new_chunks(table(spark, sf_dir, "search_results"), table(spark, sf_dir, "chunks")).select("result_id")


@query("SELECT result_id FROM search_results s WHERE text IS NULL OR NOT EXISTS (SELECT 1 FROM chunks c WHERE c.text = s.text)", name="add_chunks_dedup_global")
def add_chunks_dedup_global(spark, sf_dir):
    return store.new_chunks(table(spark, sf_dir, "search_results"), table(spark, sf_dir, "chunks"), "global").select("result_id")


@query(f"SELECT chunk_key, collection FROM {CHUNKS} WHERE collection <> '{HOT}'")
def delete_collection(spark, sf_dir):
    return store.without(chunks(spark, sf_dir), HOT).select("chunk_key", "collection")


@query(f"SELECT chunk_key, collection FROM {CHUNKS} WHERE NOT (collection = '{HOT}' AND episode_num = 3)")
def delete_episode(spark, sf_dir):
    return store.without(chunks(spark, sf_dir), HOT, 3).select("chunk_key", "collection")


LOCATION = """CASE WHEN source_type IN ('video', 'audio') THEN time_label || '|' || start_sec || '|' || end_sec WHEN source_type = 'code' THEN file_path || '|' || line_start || '|' || line_end
  ELSE page_num || '|' || section_heading || '|' || chapter END"""


@query(f"SELECT id AS chunk_id, 1.0::DOUBLE AS score, (length(text) // 4)::INTEGER AS token_count, {', '.join(store.COMPACT)}, {LOCATION} AS location FROM {CHUNKS}")
def compact_result(spark, sf_dir):
    return store.compact_results(chunks(spark, sf_dir), F.lit(1.0))


@query(
    f"""
WITH k AS (SELECT content_hash, max(chunk_key) AS entry FROM {CHUNKS} WHERE content_hash <> '' AND title <> '' AND summary <> '' AND questions <> '' GROUP BY 1)
SELECT chunk_key, k.entry, k.entry IS NOT NULL AS cached FROM {CHUNKS} c LEFT JOIN k ON k.content_hash = substr(sha256(text), 1, 16)
"""
)
def enrichment_cache_join(spark, sf_dir):
    c = chunks(spark, sf_dir)
    cache = c.where("content_hash <> '' AND title <> '' AND summary <> '' AND questions <> ''").groupBy("content_hash").agg(F.max("chunk_key").alias("entry"))
    return c.select("chunk_key", T.content_hash(F.col("text")).alias("content_hash")).join(cache, "content_hash", "left").select("chunk_key", "entry", F.col("entry").isNotNull().alias("cached"))


@query(
    f"""
WITH s AS (SELECT collection, episode_num, chunk_index, max(struct_pack(k := chunk_key, t := chapter)) AS best FROM {CHUNKS} WHERE chapter <> '' GROUP BY ALL)
SELECT c.chunk_key, CASE WHEN NOT starts_with(s.best.t, '<Untitled') THEN s.best.t END AS chapter_title
FROM {CHUNKS} c ASOF LEFT JOIN s ON c.collection = s.collection AND c.episode_num = s.episode_num AND c.chunk_index >= s.chunk_index
"""
)
def chapter_asof(spark, sf_dir):
    return store.as_of_chapter(chunks(spark, sf_dir), ["collection", "episode_num"], "chunk_index", "chapter", "chunk_key")


@query(
    f"""
WITH RECURSIVE c AS (SELECT collection, episode_num, chunk_key, length(text) // 4 AS t, row_number() OVER (PARTITION BY collection, episode_num ORDER BY chunk_index, chunk_key) AS k FROM {CHUNKS}),
p AS (SELECT collection, episode_num, chunk_key, k, t AS filled, 1 AS page FROM c WHERE k = 1
  UNION ALL SELECT c.collection, c.episode_num, c.chunk_key, c.k, CASE WHEN filled + t > 800 THEN t ELSE filled + t END, CASE WHEN filled + t > 800 THEN page + 1 ELSE page END
  FROM p JOIN c ON c.collection = p.collection AND c.episode_num = p.episode_num AND c.k = p.k + 1)
SELECT collection, episode_num, chunk_key, page FROM p
"""
)
def context_pages(spark, sf_dir):
    c = chunks(spark, sf_dir).select("collection", "episode_num", "chunk_index", "chunk_key", T.token_estimate(F.col("text")).alias("tokens"))
    return store.pages(c, ["collection", "episode_num"], ["chunk_index", "chunk_key"], "chunk_key", "tokens", 800)


@query(
    r"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_no, result_id) AS n FROM search_results QUALIFY n <= 5)
SELECT query_id, string_agg('[Source ' || n || '] ' || coalesce(collection_display, '') || ' — ' || coalesce(episode_title, '') || chr(10) || 'Timestamp: ' || coalesce(time_label, '00:00') || ' | ' || coalesce(url, '') || chr(10) || chr(10)
  || substr(coalesce(text, ''), 1, 800), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM r GROUP BY 1
"""
)
def rag_context(spark, sf_dir):
    """The five best sources of each query as the context of an answer."""
    w = Window.partitionBy("query_id").orderBy("rank_no", "result_id")
    r = table(spark, sf_dir, "search_results").withColumn("n", F.row_number().over(w)).where("n <= 5")
    blank = lambda c, d="": F.coalesce(F.col(c), F.lit(d))
    part = F.concat(
        F.lit("[Source "), F.col("n").cast("string"), F.lit("] "), blank("collection_display"), F.lit(" — "), blank("episode_title"), F.lit("\nTimestamp: "), blank("time_label", "00:00"),
        F.lit(" | "), blank("url"), F.lit("\n\n"), F.substring(blank("text"), 1, 800),
    )
    parts = r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", part.alias("part")))).alias("p"))
    return parts.select("query_id", F.array_join(F.transform("p", lambda p: p["part"]), "\n\n---\n\n").alias("context"))


@query(f"SELECT collection, coalesce(nullif(section_heading, ''), '(untitled)') AS section, count(*) AS chunks, sum(length(text) // 4)::BIGINT AS tokens FROM {CHUNKS} GROUP BY ALL")
def section_groups(spark, sf_dir):
    section = F.coalesce(F.nullif(F.col("section_heading"), F.lit("")), F.lit("(untitled)"))
    return chunks(spark, sf_dir).groupBy("collection", section.alias("section")).agg(F.count("*").alias("chunks"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))
