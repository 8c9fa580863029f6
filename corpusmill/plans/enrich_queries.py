"""Queries of enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import enrich
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval_queries import TERMS
from corpusmill.plans.tables import CHUNKS, chunks
from corpusmill.session import table

TAGS = "list_filter(list_transform(string_split(concept_tags, ','), lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '')"


@query(
    f"""
WITH d AS (SELECT chunk_key, {TERMS.format('text')} AS t, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS w FROM chunks WHERE text IS NOT NULL),
g AS (SELECT chunk_key, w, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS keyword FROM d),
tf AS (SELECT chunk_key, w, keyword, count(*) AS tf FROM g GROUP BY ALL), f AS (SELECT keyword, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM d),
s AS (SELECT chunk_key, keyword, round(tf * ln((1 + n)::DOUBLE / (1 + df)), 6) AS score FROM tf JOIN f USING (keyword), n WHERE w >= 10)
SELECT chunk_key, keyword, score, (row_number() OVER (PARTITION BY chunk_key ORDER BY score DESC, keyword))::INTEGER AS rank FROM s QUALIFY rank <= 6
"""
)
def keywords_tfidf(spark, sf_dir):
    return enrich.keywords(table(spark, sf_dir, "chunks"), "chunk_key", "text")


@query("SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'))) AS name FROM documents WHERE text IS NOT NULL")
def entities_regex(spark, sf_dir):
    return enrich.capitalised(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT collection, tag, min(chunk_index) AS first_chunk, max(chunk_index) AS last_chunk, count(*) AS count FROM (SELECT collection, chunk_index, unnest({TAGS}) AS tag FROM {CHUNKS}) GROUP BY ALL")
def rolling_keys(spark, sf_dir):
    return enrich.rolling_keys(chunks(spark, sf_dir))


@query(f"SELECT tag, count(*) AS sections FROM (SELECT DISTINCT collection, coalesce(nullif(section_heading, ''), chapter) AS section, unnest({TAGS}) AS tag FROM {CHUNKS}) GROUP BY 1 ORDER BY sections DESC, tag LIMIT 20")
def concept_sections(spark, sf_dir):
    return enrich.concept_sections(chunks(spark, sf_dir))


@query()
def concept_ledger(spark, sf_dir):
    """Ratings and fetches of the log as updates of the ledger of each session's queries."""
    log = table(spark, sf_dir, "interactions").where("query IS NOT NULL").select("id", "session_id", "occurred_at", "query", "action", "rating").distinct()
    act = F.when(F.col("rating") < 0, "downweight").when(F.col("action").isin("search", "search_deep"), "add").otherwise("mention")
    return enrich.concept_ledger(log.withColumn("act", act), ["session_id"], ["occurred_at", "id"], "query", "act")
