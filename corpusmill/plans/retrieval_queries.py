"""Queries of retrieval. Searches take every interaction with a query whose id is divisible by 50, against all chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import feedback
from corpusmill.operators import retrieval as R
from corpusmill.plans.registry import query
from corpusmill.plans.tables import CHUNKS, chunks
from corpusmill.session import table

NOW = "2025-06-30 00:00:00+00:00"


def queries(spark, sf_dir):
    """qid, query and the query's vector (null where the vectors end)."""
    q = table(spark, sf_dir, "interactions").where("id % 50 = 0 AND query IS NOT NULL").groupBy(F.col("id").alias("qid")).agg(F.min("query").alias("query"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return q.join(v, "qid", "left")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_key"), F.col("embedding").alias("vector"))


STOP = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
TERMS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: w NOT IN (" + STOP + "))"
Q = "q AS (SELECT i.qid, i.query, v.embedding AS vector FROM (SELECT id AS qid, min(query) AS query FROM interactions WHERE id % 50 = 0 AND query IS NOT NULL GROUP BY 1) i LEFT JOIN embeddings v ON v.vec_id = i.qid)"


def _vec(where: str = "true", most: int = 30, name: str = "vec") -> str:
    return f"""{name} AS (SELECT qid, chunk_key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_key) AS rank FROM (
  SELECT q.qid, c.chunk_key, round(list_cosine_similarity(q.vector::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS score
  FROM q, {CHUNKS} c JOIN embeddings e ON e.vec_id = c.chunk_key WHERE q.vector IS NOT NULL AND {where}) QUALIFY rank <= {most})"""


def _bm25(where: str = "true", most: int = 30, base: str = "q") -> str:
    return f"""d AS (SELECT chunk_key, {TERMS.format('text')} AS t FROM {CHUNKS}),
tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT term, chunk_key, dl, count(*) AS tf FROM (SELECT chunk_key, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT term, chunk_key, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM p JOIN f USING (term), tot),
fts AS (SELECT qid, chunk_key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_key) AS rank FROM (
  SELECT qid, chunk_key, round(sum(w), 6) AS score FROM (SELECT DISTINCT qid, unnest({TERMS.format('query')}) AS term FROM {base}) JOIN w USING (term) GROUP BY ALL)
  WHERE chunk_key IN (SELECT chunk_key FROM {CHUNKS} c WHERE {where}) QUALIFY rank <= {most})"""


TAGS = "list_filter(list_transform(string_split({}, ','), lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '')"
NAMES = "list_filter(list_transform(CASE WHEN json_valid(entities) AND json_type(entities) = 'ARRAY' THEN json_extract(entities, '$[*]') ELSE [] END, lambda e: lower(e ->> '$.name')), lambda x: x <> '')"
LABELS = f"lab AS (SELECT chunk_key, list_distinct(list_concat({NAMES}, {TAGS.format('keywords')}, {TAGS.format('concept_tags')})) AS labels FROM {CHUNKS})"
ASKED = "list_distinct(list_concat([lower(trim(query))], list_filter(string_split_regex(lower(query), '\\s+'), lambda w: w <> '')))"
ENT = f"""cand AS (SELECT qid, chunk_key FROM vec UNION SELECT qid, chunk_key FROM fts),
ent AS (SELECT qid, chunk_key, overlap, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, chunk_key) AS rank FROM (
  SELECT cand.qid, cand.chunk_key, len(list_intersect({ASKED}, labels)) AS overlap FROM cand JOIN q USING (qid) JOIN lab USING (chunk_key)) WHERE overlap > 0)"""
RRF = """rrf AS (SELECT qid, chunk_key, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM ({}) GROUP BY ALL),
best AS (SELECT qid, chunk_key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_key) AS rank FROM rrf)"""
TWO, THREE = (" UNION ALL ".join(f"SELECT qid, chunk_key, rank FROM {x}" for x in k) for k in (("vec", "fts"), ("vec", "fts", "ent")))
OUT = "SELECT qid, chunk_key, score, rank::INTEGER AS rank FROM "


@query(f"WITH q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 50 = 0) SELECT qid, vec_id, score, rank::INTEGER AS rank FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.qid, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS score FROM q, embeddings e)) WHERE rank <= 10")
def vector_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return R.vector_search(e, "vec_id", "embedding", q, "qid", "qv", 10)


@query(f"WITH q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 50 = 0) SELECT qid, vec_id, score, rank::INTEGER AS rank FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.qid, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS score FROM q, embeddings e WHERE e.label = 3)) WHERE rank <= 10")
def vector_search_filtered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return R.vector_search(e, "vec_id", "embedding", q, "qid", "qv", 10, F.col("label") == 3)


@query(f"SELECT term, chunk_key, dl::INTEGER AS dl, count(*) AS tf FROM (SELECT chunk_key, len(t) AS dl, unnest(t) AS term FROM (SELECT chunk_key, {TERMS.format('text')} AS t FROM chunks WHERE text IS NOT NULL)) GROUP BY ALL")
def inverted_index(spark, sf_dir):
    return R.postings(table(spark, sf_dir, "chunks"), "chunk_key", "text")


@query(f"WITH {Q}, {_bm25()} {OUT} fts")
def bm25_search(spark, sf_dir):
    return R.bm25(chunks(spark, sf_dir), "chunk_key", "text", queries(spark, sf_dir), "qid", "query")


def _two_lists(spark, sf_dir):
    c, q = chunks(spark, sf_dir), queries(spark, sf_dir)
    vec = R.vector_search(c.select("chunk_key").join(vectors(spark, sf_dir), "chunk_key"), "chunk_key", "vector", q, "qid", "vector", R.CANDIDATES)
    return c, q, vec, R.bm25(c, "chunk_key", "text", q, "qid", "query")


@query(f"WITH {Q}, {_vec()}, {_bm25()}, {RRF.format(TWO)} {OUT} best WHERE rank <= 20")
def hybrid_rrf(spark, sf_dir):
    _, _, vec, fts = _two_lists(spark, sf_dir)
    return R.ranked(R.fuse([vec, fts], "qid", "chunk_key"), "qid", "score", "chunk_key", 20)


GARDENING = "c.topic = 'gardening'"


@query(f"WITH {Q}, {_bm25(where=GARDENING)} {OUT} fts")
def topic_prefilter_topk(spark, sf_dir):
    """The filter comes before the best are taken; statistics are those of all chunks."""
    c = chunks(spark, sf_dir)
    scored = R.bm25(c, "chunk_key", "text", queries(spark, sf_dir), "qid", "query", None).drop("rank")
    kept = c.where(F.col("topic") == "Gardening".lower()).select("chunk_key")
    return R.ranked(scored.join(kept, "chunk_key", "left_semi"), "qid", "score", "chunk_key", R.CANDIDATES).select("qid", "chunk_key", "score", "rank")


@query(f"WITH {Q}, {_vec()}, {_bm25()}, {LABELS}, {ENT} SELECT qid, chunk_key, overlap::INTEGER AS overlap, rank::INTEGER AS rank FROM ent")
def entity_rank(spark, sf_dir):
    c, q, vec, fts = _two_lists(spark, sf_dir)
    found = vec.select("qid", "chunk_key").unionByName(fts.select("qid", "chunk_key")).distinct()
    both = found.join(q.select("qid", R.query_entities(F.col("query")).alias("asked")), "qid").join(c.select("chunk_key", R.labels(c).alias("labels")), "chunk_key")
    return R.entity_rank(both, "qid", "chunk_key", "asked", "labels")


@query(f"WITH {Q}, {_vec()}, {_bm25()}, {LABELS}, {ENT}, {RRF.format(THREE)} SELECT qid, chunk_key, 1.0::DOUBLE AS score, rank::INTEGER AS rank FROM best WHERE rank <= 5")
def rerank_identity(spark, sf_dir):
    return R.search(chunks(spark, sf_dir), vectors(spark, sf_dir), queries(spark, sf_dir), 5)


IDS = "coalesce(from_json(CASE WHEN json_valid({0}) THEN {0} END, '[\"VARCHAR\"]'), [])"
#: Ratings by chunk id: each interaction counts a fetched or ignored id once.
RATINGS = f"""iu AS (SELECT DISTINCT id, session_id, occurred_at, action, {IDS.format('chunk_ids_shown')} AS s, {IDS.format('chunk_ids_fetched')} AS f, {IDS.format('chunk_ids_rated')} AS g, rating FROM interactions),
ev AS (SELECT unnest(list_distinct(f)) AS chunk_id, 1 AS fe, 0 AS ig, 0 AS up, 0 AS dn FROM iu
  UNION ALL SELECT unnest(list_distinct(list_filter(s, lambda x: NOT list_contains(f, x)))), 0, 1, 0, 0 FROM iu WHERE len(f) > 0
  UNION ALL SELECT unnest(list_distinct(g)), 0, 0, (rating > 0)::INTEGER, (rating <= 0)::INTEGER FROM iu WHERE rating IS NOT NULL),
rat AS (SELECT chunk_id, sum(fe)::BIGINT AS fetches, sum(ig)::BIGINT AS ignores, sum(up)::BIGINT AS explicit_up, sum(dn)::BIGINT AS explicit_down FROM ev GROUP BY 1)"""
WILSON = "CASE WHEN {a} + {b} = 0 THEN 0.5 ELSE (({a})::DOUBLE / ({a} + {b}) + 3.8416 / (2 * ({a} + {b})) - 1.96 * sqrt((({a})::DOUBLE / ({a} + {b}) * (1 - ({a})::DOUBLE / ({a} + {b})) + 3.8416 / (4 * ({a} + {b}))) / ({a} + {b}))) / (1 + 3.8416 / ({a} + {b})) END"
BOOST = f"""CASE WHEN rat.chunk_id IS NOT NULL THEN 0.1 * (({WILSON.format(a='(fetches + 3 * explicit_up)', b='(ignores + 3 * explicit_down)')}) - 0.5) ELSE 0 END
  + CASE WHEN c.importance IN (0, 3) THEN 0 ELSE 0.05 * (greatest(1, least(5, c.importance)) - 3) / 2 END"""


@query(f"""WITH {Q}, {_bm25(most=5)}, {RATINGS} SELECT qid, chunk_key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, was)::INTEGER AS rank FROM (
  SELECT qid, fts.chunk_key, fts.rank AS was, round(1.0 + {BOOST}, 6) AS score FROM fts JOIN {CHUNKS} c USING (chunk_key) LEFT JOIN rat ON rat.chunk_id = c.id)""")
def rating_boost(spark, sf_dir):
    """The best five by text, moved by ratings and importance among themselves."""
    base = R.bm25(chunks(spark, sf_dir), "chunk_key", "text", queries(spark, sf_dir), "qid", "query", 5).withColumn("score", F.lit(1.0))
    return R.moved_by_ratings(base, chunks(spark, sf_dir), feedback.chunk_ratings(table(spark, sf_dir, "interactions")))


@query(f"""WITH {Q}, {_bm25(most=5)}, iu AS (SELECT DISTINCT id, session_id, occurred_at, action, chunk_ids_fetched FROM interactions),
s AS (SELECT id AS qid, session_id, occurred_at FROM iu WHERE id % 50 = 0),
h AS (SELECT DISTINCT s.qid, unnest({IDS.format('chunk_ids_fetched')}) AS chunk_id FROM s JOIN iu ON iu.session_id = s.session_id AND iu.action = 'get_context' AND iu.occurred_at > s.occurred_at - INTERVAL 30 MINUTE AND iu.occurred_at <= s.occurred_at)
SELECT qid, chunk_key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, was)::INTEGER AS rank FROM (SELECT fts.qid, fts.chunk_key, fts.rank AS was, CASE WHEN h.chunk_id IS NULL THEN 1.0 ELSE 0.5 END::DOUBLE AS score
  FROM fts JOIN {CHUNKS} c USING (chunk_key) LEFT JOIN h ON h.qid = fts.qid AND h.chunk_id = c.id)""")
def session_decay(spark, sf_dir):
    """The best five by text; what the session fetched in the half hour before the query counts half."""
    base = R.bm25(chunks(spark, sf_dir), "chunk_key", "text", queries(spark, sf_dir), "qid", "query", 5).withColumn("score", F.lit(1.0))
    return R.decayed(base, chunks(spark, sf_dir), _seen(spark, sf_dir))


def _seen(spark, sf_dir):
    """qid and chunk_id of what each query's session had fetched in the half hour before."""
    log = table(spark, sf_dir, "interactions")
    asked = log.where("id % 50 = 0").select(F.col("id").alias("qid"), "session_id", F.col("occurred_at").alias("now")).distinct()
    return feedback.fetched(log, asked, "qid")


@query(f"""WITH n AS (SELECT t.chunk_key, r.start_sec, r.end_sec, arg_min(r.text, r.chunk_key) AS text FROM {CHUNKS} t JOIN {CHUNKS} r
  ON t.collection = r.collection AND t.episode_num = r.episode_num AND r.start_sec BETWEEN greatest(0, t.start_sec - 150) AND t.start_sec + 150 WHERE t.chunk_key % 50 = 0 AND (t.start_sec > 0 OR t.end_sec > 0) GROUP BY ALL)
SELECT chunk_key, string_agg(text, chr(10) || chr(10) ORDER BY start_sec, end_sec) AS text, min(start_sec) AS start_sec, arg_max(end_sec, struct_pack(a := start_sec, b := end_sec)) AS end_sec FROM n GROUP BY 1""")
def parent_expand_temporal(spark, sf_dir):
    c = chunks(spark, sf_dir)
    hits = c.where("chunk_key % 50 = 0 AND (start_sec > 0 OR end_sec > 0)").select("chunk_key", "collection", "episode_num", "start_sec")
    return R.expand(hits, "chunk_key", c, "start_sec", 150)


@query(f"""SELECT t.chunk_key, string_agg(r.text, chr(10) || chr(10) ORDER BY r.chunk_index, r.chunk_key) AS text FROM {CHUNKS} t JOIN {CHUNKS} r
  ON t.collection = r.collection AND t.episode_num = r.episode_num AND r.chunk_index BETWEEN greatest(0, t.chunk_index - 2) AND t.chunk_index + 2 WHERE t.chunk_key % 50 = 0 AND t.start_sec <= 0 AND t.end_sec <= 0 GROUP BY 1""")
def parent_expand_index(spark, sf_dir):
    c = chunks(spark, sf_dir)
    hits = c.where("chunk_key % 50 = 0 AND start_sec <= 0 AND end_sec <= 0").select("chunk_key", "collection", "episode_num", "chunk_index")
    return R.expand(hits, "chunk_key", c, "chunk_index", 2)


FETCHED = f"""se AS (SELECT DISTINCT id AS qid, session_id, occurred_at FROM iu WHERE id % 50 = 0),
h AS (SELECT DISTINCT se.qid, unnest({IDS.format('chunk_ids_fetched')}) AS chunk_id FROM se JOIN (SELECT DISTINCT session_id, action, occurred_at, chunk_ids_fetched FROM interactions) i
  ON i.session_id = se.session_id AND i.action = 'get_context' AND i.occurred_at > se.occurred_at - INTERVAL 30 MINUTE AND i.occurred_at <= se.occurred_at)"""


def _search(parent: str = "qid") -> str:
    """Tables from vec to res: the whole pipeline up to ranked results, over the queries of q; ``parent`` gives the query whose session counts."""
    return f"""{_vec()}, {_bm25()}, {LABELS}, {ENT}, {RRF.format(THREE)}, {RATINGS}, {FETCHED},
top AS (SELECT qid, chunk_key, rank AS was FROM best WHERE rank <= 5),
sc AS (SELECT qid, top.chunk_key, was, round(1.0 + {BOOST}, 6) AS score FROM top JOIN {CHUNKS} c USING (chunk_key) LEFT JOIN rat ON rat.chunk_id = c.id),
rk AS (SELECT qid, chunk_key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, was) AS was FROM sc),
dc AS (SELECT rk.qid, rk.chunk_key, CASE WHEN h.chunk_id IS NULL THEN rk.score ELSE rk.score * 0.5 END AS score, rk.was FROM rk JOIN {CHUNKS} c USING (chunk_key) LEFT JOIN h ON h.qid = {parent.replace('qid', 'rk.qid')} AND h.chunk_id = c.id),
res AS (SELECT qid, chunk_key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, was)::INTEGER AS rank FROM dc)"""


def _around(res: str) -> str:
    """Results with the text around them."""
    on = f"JOIN {CHUNKS} r ON t.collection = r.collection AND t.episode_num = r.episode_num"
    return f"""hit AS (SELECT * FROM {CHUNKS} WHERE chunk_key IN (SELECT chunk_key FROM {res})),
tm AS (SELECT t.chunk_key, r.start_sec, r.end_sec, arg_min(r.text, r.chunk_key) AS text FROM hit t {on} AND r.start_sec BETWEEN greatest(0, t.start_sec - 150) AND t.start_sec + 150 WHERE t.start_sec > 0 OR t.end_sec > 0 GROUP BY ALL),
txt AS (SELECT chunk_key, string_agg(text, chr(10) || chr(10) ORDER BY start_sec, end_sec) AS text, min(start_sec) AS start_sec, arg_max(end_sec, struct_pack(a := start_sec, b := end_sec)) AS end_sec FROM tm GROUP BY 1
  UNION ALL SELECT t.chunk_key, string_agg(r.text, chr(10) || chr(10) ORDER BY r.chunk_index, r.chunk_key), 0, 0 FROM hit t {on} AND r.chunk_index BETWEEN greatest(0, t.chunk_index - 2) AND t.chunk_index + 2 WHERE t.start_sec <= 0 AND t.end_sec <= 0 GROUP BY 1)
SELECT res.qid, res.chunk_key, res.score, res.rank, md5(txt.text) AS text_md5, txt.start_sec, txt.end_sec FROM {res} res JOIN txt USING (chunk_key)"""


def _hashed(found):
    return found.select("qid", "chunk_key", "score", "rank", F.md5("text").alias("text_md5"), "start_sec", "end_sec")


@query(f"WITH {Q}, {_search()}, {_around('res')}")
def search(spark, sf_dir):
    """The whole pipeline: candidates, fusion, ratings, what the session has seen, and the text around the results."""
    ratings = feedback.chunk_ratings(table(spark, sf_dir, "interactions"))
    return _hashed(R.search(chunks(spark, sf_dir), vectors(spark, sf_dir), queries(spark, sf_dir), 5, ratings=ratings, seen=_seen(spark, sf_dir), around=True))


TOPIC = "(c.topic = 'gardening' AND c.subtopic <> '')"


@query(f"WITH {Q}, {_vec(where=TOPIC)}, {_bm25(where=TOPIC)}, {LABELS}, {ENT}, {RRF.format(THREE)} SELECT qid, chunk_key, 1.0::DOUBLE AS score, rank::INTEGER AS rank FROM best WHERE rank <= 5")
def search_in_topic(spark, sf_dir):
    """Search among the chunks of one topic that have a subtopic."""
    return R.search(chunks(spark, sf_dir), vectors(spark, sf_dir), queries(spark, sf_dir), 5, R.of_topic("Gardening") & (F.col("subtopic") != ""))


@query(r"""
WITH l AS (SELECT DISTINCT id, query, unnest(string_split(query || chr(10) || '1. ' || query || chr(10) || '"short"', chr(10))) AS line, generate_subscripts(string_split(query || chr(10) || '1. ' || query || chr(10) || '"short"', chr(10)), 1) AS n FROM interactions WHERE query IS NOT NULL),
c AS (SELECT id, n, regexp_replace(regexp_replace(trim(regexp_replace(line, '^\s*\d+[.):\-]\s*', '')), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') AS q FROM l)
SELECT id, string_agg(q, '|' ORDER BY n) AS sub_queries FROM c WHERE length(q) > 5 GROUP BY id
""")
def parse_sub_queries(spark, sf_dir):
    """A reply that repeats each query plainly, numbered, and beside a line that is too short."""
    q = table(spark, sf_dir, "interactions").where("query IS NOT NULL").select("id", "query").distinct()
    reply = F.concat(F.col("query"), F.lit("\n1. "), F.col("query"), F.lit('\n"short"'))
    return q.select("id", F.array_join(T.query_lines(reply), "|").alias("sub_queries")).where("sub_queries <> ''")


HOPS = "q0 AS (SELECT id AS qid0, min(query) AS query FROM interactions WHERE id % 50 = 0 AND query IS NOT NULL GROUP BY 1), hops AS (SELECT qid0, unnest([query, split_part(query, ' ', -1)]) AS query, unnest([0, 1]) AS hop FROM q0), q AS (SELECT qid0 || '#' || hop AS qid, hops.query, v.embedding AS vector FROM hops LEFT JOIN embeddings v ON v.vec_id = qid0 + hop)"


PARENT = "split_part(qid, '#', 1)::BIGINT"


@query(f"""WITH {HOPS}, {_search(PARENT)}, mh AS (SELECT {PARENT} AS qid, chunk_key, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM res GROUP BY ALL),
fin AS (SELECT qid, chunk_key, 1.0::DOUBLE AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_key) AS rank FROM mh) WHERE rank <= 5), {_around('fin')}""")
def search_multi_hop(spark, sf_dir):
    """Each query as two hops, itself and its last word, through the whole pipeline; the text around the results comes once, at the end."""
    q = queries(spark, sf_dir)
    hops = q.select("qid", F.posexplode(F.array("query", F.element_at(F.split("query", " "), -1))).alias("hop", "query"))
    v = vectors(spark, sf_dir).withColumnRenamed("chunk_key", "vid")
    sub = hops.join(v, F.col("vid") == F.col("qid") + F.col("hop"), "left").select("qid", "hop", "query", "vector")
    ratings = feedback.chunk_ratings(table(spark, sf_dir, "interactions"))
    return _hashed(R.multi_hop(chunks(spark, sf_dir), vectors(spark, sf_dir), q, sub, 5, ratings=ratings, seen=_seen(spark, sf_dir), around=True))


@query(f"""WITH RECURSIVE {Q}, {_bm25(most=1)}, {RATINGS}, {FETCHED}, t AS (SELECT qid, (qid // 50) % 3 AS d, 120 * ((qid // 150) % 3 + 1) AS amount, c.* FROM fts JOIN {CHUNKS} c USING (chunk_key)),
b AS (SELECT *, CASE WHEN timed THEN start_sec ELSE chunk_index END AS spot, CASE WHEN NOT timed THEN greatest(2, amount // 60) WHEN d = 0 THEN amount // 2 ELSE amount END AS reach FROM (SELECT *, start_sec > 0 OR end_sec > 0 AS timed FROM t)),
n AS (SELECT b.qid, r.chunk_key, (length(r.text) // 4)::INTEGER AS tokens, row_number() OVER (PARTITION BY b.qid ORDER BY r.start_sec, r.chunk_index, r.chunk_key) AS k FROM b JOIN {CHUNKS} r ON b.collection = r.collection AND b.episode_num = r.episode_num
  AND CASE WHEN timed THEN r.start_sec ELSE r.chunk_index END BETWEEN CASE WHEN d = 2 THEN spot ELSE greatest(0, spot - reach) END AND CASE WHEN d = 1 THEN spot ELSE spot + reach END
  WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.qid = b.qid AND h.chunk_id = r.id)),
pg AS (SELECT qid, chunk_key, tokens, k, tokens AS filled, 1 AS page FROM n WHERE k = 1
  UNION ALL SELECT n.qid, n.chunk_key, n.tokens, n.k, CASE WHEN filled + n.tokens > 400 THEN n.tokens ELSE filled + n.tokens END, CASE WHEN filled + n.tokens > 400 THEN page + 1 ELSE page END FROM pg JOIN n ON n.qid = pg.qid AND n.k = pg.k + 1)
SELECT qid, chunk_key, tokens, k::INTEGER AS place, page::INTEGER AS page FROM pg""")
def get_context(spark, sf_dir):
    """What stands around, before or after the best hit of each query, in pages of 400 tokens, without what the session has fetched lately."""
    c = chunks(spark, sf_dir)
    best = R.bm25(c, "chunk_key", "text", queries(spark, sf_dir), "qid", "query", 1).select("qid", "chunk_key")
    way = F.pmod(F.floor(F.col("qid") / 50), F.lit(3))
    t = best.join(c.select("chunk_key", "collection", "episode_num", "start_sec", "end_sec", "chunk_index"), "chunk_key").withColumns({"direction": F.when(way == 0, "around").when(way == 1, "before").otherwise("after"), "amount": (120 * (F.pmod(F.floor(F.col("qid") / 150), F.lit(3)) + 1)).cast("int")})
    found = R.context(t.withColumnRenamed("qid", "tid"), c, _seen(spark, sf_dir).withColumnRenamed("qid", "tid"), 400)
    return found.withColumnRenamed("tid", "qid")


@query(f"WITH {Q}, {_vec(most=10)}, {_bm25(most=10)} SELECT fts.qid, round(100.0 * count(vec.chunk_key) / count(*), 4)::DOUBLE AS overlap FROM fts LEFT JOIN vec ON vec.qid = fts.qid AND vec.chunk_key = fts.chunk_key GROUP BY 1")
def result_overlap(spark, sf_dir):
    _, _, vec, fts = _two_lists(spark, sf_dir)
    return R.result_overlap(fts.where("rank <= 10"), vec.where("rank <= 10"), "qid", "chunk_key")
