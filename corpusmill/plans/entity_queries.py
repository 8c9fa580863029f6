"""Queries of entities and their graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import entities as E
from corpusmill.operators import graph as G
from corpusmill.operators import retrieval as R
from corpusmill.plans.registry import query
from corpusmill.plans.tables import CHUNKS, chunks
from corpusmill.session import materialize, once


def _list(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


NORM = "trim(trim(trim(regexp_replace(regexp_replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '''s$', ''), '" + E.LEADING + "', '')), '''\".,;:!?()[]{{}}'))"
NOISE = f"""(length(name) < 2 OR (length(name) <= 3 AND upper(name) = name AND lower(name) <> name) OR regexp_matches(name, '{E.STRUCTURAL}') OR regexp_matches(name, '{E.ROMAN}')
  OR lower(name) IN ({_list(E.STOP_ENTITIES)}) OR regexp_matches(name, '^[.\\-()\\[\\]0-9 ]*$') OR length(name) - length(replace(name, ' ', '')) > 6)"""
COARSE = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in E.COARSE.items()) + " ELSE {0} END"
NEEDS = "CASE WHEN len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')) >= 2 THEN 90.0 WHEN length({0}) <= 5 THEN 100.0 WHEN length({0}) <= 8 THEN 95.0 ELSE 93.0 END"
RAW = f"""raw AS (SELECT chunk_key, collection AS source, n - 1 AS place, el[n] ->> '$.name' AS raw, coalesce(el[n] ->> '$.type', 'UNKNOWN') AS type FROM (
  SELECT chunk_key, collection, el, unnest(range(1, len(el) + 1)) AS n FROM (SELECT chunk_key, collection, CASE WHEN json_valid(entities) AND json_type(entities) = 'ARRAY' THEN json_extract(entities, '$[*]') ELSE [] END AS el FROM {CHUNKS}))
  WHERE el[n] ->> '$.name' IS NOT NULL)"""
# The decomposed form of the corpus's accents is one letter and one mark, which the queries fold away on both sides.
MENTIONS = f"""{RAW}, men AS (SELECT chunk_key, source, place, raw, name, CASE WHEN lower(name) IN ({_list(E.PLACES)}) AND type IN ('PERSON', 'ORG') THEN 'GPE' ELSE type END AS type
  FROM (SELECT *, {NORM.format('strip_accents(raw)')} AS name FROM raw) WHERE NOT {NOISE})"""
NAMES = f"""{MENTIONS}, votes AS (SELECT name, type, count(*) AS n, min(chunk_key) AS first_key FROM men GROUP BY ALL),
nam AS (SELECT v.name, sum(n)::BIGINT AS mentions, min(first_key) AS first_key, arg_min(type, struct_pack(a := -n, b := type)) AS type, any_value(sources) AS sources
  FROM votes v JOIN (SELECT name, count(DISTINCT source) AS sources FROM men GROUP BY 1) USING (name) GROUP BY v.name)"""
PAIRS = f"""{NAMES}, low AS (SELECT name, lower(name) AS l, type, {COARSE.format('type')} AS co, {NEEDS.format('name')} AS needs FROM nam),
prs AS (SELECT a.name AS a, b.name AS b, round(jaro_winkler_similarity(a.l, b.l) * 100, 6) AS score FROM low a JOIN low b ON a.name < b.name
  AND round(jaro_winkler_similarity(a.l, b.l) * 100, 6) >= greatest(a.needs, b.needs) AND (a.co = b.co OR a.type IN ('UNKNOWN', '') OR b.type IN ('UNKNOWN', '')))"""
CLUSTERS = PAIRS + """, ord AS (SELECT name, row_number() OVER (ORDER BY mentions DESC, first_key, name) AS o FROM nam),
two AS (SELECT a AS x, b AS y, score FROM prs UNION ALL SELECT b, a, score FROM prs),
par AS (SELECT x, arg_min(y, struct_pack(s := -score, o := oy.o)) AS parent FROM two JOIN ord ox ON ox.name = x JOIN ord oy ON oy.name = y WHERE oy.o < ox.o GROUP BY x),
up AS (SELECT name, coalesce(parent, name) AS root, 0 AS k FROM nam LEFT JOIN par ON par.x = nam.name UNION ALL SELECT up.name, par.parent, k + 1 FROM up JOIN par ON par.x = up.root),
clu AS (SELECT name, arg_max(root, k) AS canonical FROM up GROUP BY name)"""
INC = CLUSTERS + """, ce AS (SELECT DISTINCT chunk_key, canonical AS entity FROM men JOIN clu USING (name)), inc AS (SELECT * FROM ce WHERE chunk_key IN (SELECT chunk_key FROM ce GROUP BY 1 HAVING count(*) > 1)),
ver AS (SELECT entity, count(*) AS docfreq FROM inc GROUP BY 1), coo AS (SELECT x.entity AS a, y.entity AS b, count(*) AS cooccur FROM inc x JOIN inc y ON x.chunk_key = y.chunk_key AND x.entity < y.entity GROUP BY ALL),
num AS (SELECT count(DISTINCT chunk_key)::DOUBLE AS n FROM inc),
edg AS (SELECT a, b, cooccur, npmi FROM (SELECT a, b, cooccur, round(CASE WHEN cooccur = n THEN 1.0 ELSE ln((cooccur / n) / ((va.docfreq / n) * (vb.docfreq / n))) / -ln(cooccur / n) END, 4) AS npmi
  FROM coo JOIN ver va ON va.entity = a JOIN ver vb ON vb.entity = b, num WHERE cooccur >= 3) WHERE npmi > 0),
nbr AS (SELECT a AS entity, b AS neighbor, npmi FROM edg UNION ALL SELECT b, a, npmi FROM edg),
sm AS (SELECT canonical, sum(n)::BIGINT AS mentions, arg_min(type, struct_pack(a := -n, b := type)) AS type FROM (SELECT canonical, type, count(*) AS n FROM men JOIN clu USING (name) GROUP BY ALL) GROUP BY 1)"""


def plain_mentions(spark, sf_dir):
    """Mentions with accents folded, so that SQL can express the names."""
    return E.mentions(chunks(spark, sf_dir), fold=True)


def _names(spark, sf_dir):
    """Mentions and names, built once for a session and its tables, as the engine's index is."""

    def build():
        found = materialize(plain_mentions(spark, sf_dir), "mentions")
        return found, materialize(E.names(found), "names")

    return once(spark, ("names", sf_dir), build)


def _clustered(spark, sf_dir):
    found, listed = _names(spark, sf_dir)
    return found, listed, once(spark, ("clusters", sf_dir), lambda: E.clusters(listed))


def _graph(spark, sf_dir):
    found, _, clustered = _clustered(spark, sf_dir)
    pairs = materialize(G.incidence(found, clustered), "incidence")
    return found, clustered, pairs


@query(f"WITH {MENTIONS} SELECT name, count(*) AS mentions, count(DISTINCT source) AS sources FROM men GROUP BY 1")
def entity_mentions(spark, sf_dir):
    return plain_mentions(spark, sf_dir).groupBy("name").agg(F.count("*").alias("mentions"), F.countDistinct("source").alias("sources"))


@query(f"WITH {RAW} SELECT DISTINCT raw, strip_accents({NORM.format('raw')}) AS normal FROM raw")
def entity_normalize(spark, sf_dir):
    e = chunks(spark, sf_dir).select(F.explode(F.from_json("entities", "array<string>")).alias("e")).select(F.get_json_object("e", "$.name").alias("raw")).where("raw IS NOT NULL").distinct()
    return e.select("raw", F.regexp_replace(E.normalize(F.col("raw")), r"\p{Mn}", "").alias("normal"))


@query(f"WITH {RAW} SELECT name, {NOISE} AS noise FROM (SELECT DISTINCT {NORM.format('strip_accents(raw)')} AS name FROM raw UNION SELECT DISTINCT keywords FROM {CHUNKS})")
def entity_filter(spark, sf_dir):
    c = chunks(spark, sf_dir)
    e = c.select(F.explode(F.from_json("entities", "array<string>")).alias("e")).select(F.get_json_object("e", "$.name").alias("raw")).where("raw IS NOT NULL").distinct()
    names = e.select(F.regexp_replace(E.normalize(F.col("raw")), r"\p{Mn}", "").alias("name")).unionByName(c.select(F.col("keywords").alias("name"))).distinct()
    return names.select("name", E.is_noise(F.col("name")).alias("noise"))


@query(f"WITH {RAW} SELECT DISTINCT raw, type, CASE WHEN lower(raw) IN ({_list(E.PLACES)}) AND type IN ('PERSON', 'ORG') THEN 'GPE' ELSE type END AS fixed FROM raw")
def entity_type_fix(spark, sf_dir):
    e = chunks(spark, sf_dir).select(F.explode(F.from_json("entities", "array<string>")).alias("e"))
    e = e.select(F.get_json_object("e", "$.name").alias("raw"), F.coalesce(F.get_json_object("e", "$.type"), F.lit("UNKNOWN")).alias("type")).where("raw IS NOT NULL").distinct()
    return e.select("raw", "type", E.corrected_type(F.col("raw"), F.col("type")).alias("fixed"))


@query(f"WITH {NAMES} SELECT name, {NEEDS.format('name')}::DOUBLE AS needs FROM nam")
def merge_threshold(spark, sf_dir):
    return _names(spark, sf_dir)[1].select("name", E.merge_threshold(F.col("name")).alias("needs"))


@query(f"WITH {NAMES}, l AS (SELECT DISTINCT lower(name) AS n FROM nam) SELECT a.n AS a, b.n AS b, round(jaro_winkler_similarity(a.n, b.n), 6) AS score FROM l a JOIN l b ON a.n < b.n AND jaro_winkler_similarity(a.n, b.n) + 1e-12 >= 0.9")
def jaro_winkler_pairs(spark, sf_dir):
    from corpusmill.functions.similarity import similar_pairs

    low = _names(spark, sf_dir)[1].select(F.lower("name").alias("low"))
    return similar_pairs(low, "low", 0.9).select("a", "b", F.round(F.col("score") / 100, 6).alias("score"))


@query(f"WITH {PAIRS} SELECT * FROM prs")
def entity_pairs(spark, sf_dir):
    return E.variant_pairs(_names(spark, sf_dir)[1])


@query(f"WITH {NAMES} SELECT name, type, mentions FROM nam")
def entity_majority_type(spark, sf_dir):
    return _names(spark, sf_dir)[1].select("name", "type", "mentions")


@query(f"WITH RECURSIVE {CLUSTERS} SELECT * FROM clu")
def entity_clusters(spark, sf_dir):
    return _clustered(spark, sf_dir)[2]


TAGS = f"(SELECT DISTINCT unnest(list_filter(list_transform(string_split(concept_tags, ','), lambda x: trim(x)), lambda x: x <> '')) AS name FROM {CHUNKS})"


@query(f"WITH RECURSIVE {CLUSTERS}, v AS (SELECT lower(name) AS low, max(canonical) AS canonical FROM clu GROUP BY 1) SELECT t.name, v.canonical FROM {TAGS} t LEFT JOIN v ON v.low = lower(t.name)")
def entity_resolve(spark, sf_dir):
    """Which concept tags are known entities, whatever their case."""
    tags = chunks(spark, sf_dir).select(F.explode(F.filter(F.transform(F.split("concept_tags", ","), lambda t: F.btrim(t)), lambda t: t != "")).alias("tag"))
    return E.resolve(tags, "tag", _clustered(spark, sf_dir)[2], fuzzy=False)


ASKED_LOW = f"regexp_replace(lower({NORM.format('strip_accents(name)')}), '\\p{{Mn}}', '', 'g')"


@query(f"""WITH RECURSIVE {CLUSTERS}, v AS (SELECT lower(name) AS low, max(canonical) AS canonical FROM clu GROUP BY 1),
a AS (SELECT name, {ASKED_LOW} AS low FROM (SELECT name FROM {TAGS} UNION SELECT DISTINCT raw FROM raw)),
x AS (SELECT a.name, a.low, v.canonical FROM a LEFT JOIN v ON v.low = a.low),
f AS (SELECT x.name, arg_min(v.canonical, struct_pack(s := -round(jaro_winkler_similarity(x.low, v.low) * 100, 6), b := v.low)) AS near FROM x JOIN v ON x.canonical IS NULL AND x.low <> v.low
  AND round(jaro_winkler_similarity(x.low, v.low) * 100, 6) >= greatest({NEEDS.format('x.low')}, {NEEDS.format('v.low')}) GROUP BY 1)
SELECT x.name, coalesce(x.canonical, f.near) AS canonical FROM x LEFT JOIN f ON f.name = x.name""")
def entity_resolve_fuzzy(spark, sf_dir):
    """Concept tags and names as typed: normalised, then by a variant, else by the most similar variant that is similar enough for both lengths."""
    c = chunks(spark, sf_dir)
    tags = c.select(F.explode(F.filter(F.transform(F.split("concept_tags", ","), lambda t: F.btrim(t)), lambda t: t != "")).alias("name"))
    typed = c.select(F.explode(F.from_json("entities", "array<string>")).alias("e")).select(F.get_json_object("e", "$.name").alias("name")).where("name IS NOT NULL")
    return E.resolve(tags.unionByName(typed), "name", _clustered(spark, sf_dir)[2], fold=True)


@query(f"""WITH RECURSIVE {CLUSTERS}, s AS (SELECT canonical, count(DISTINCT source) AS sources FROM men JOIN clu USING (name) GROUP BY 1), k AS (SELECT canonical, count(*) AS variants FROM clu GROUP BY 1)
SELECT count(*) AS clusters, sum(variants)::BIGINT AS variants, count(*) FILTER (variants > 1) AS merged, count(*) FILTER (sources > 1) AS cross_source FROM k JOIN s USING (canonical)""")
def entity_stats(spark, sf_dir):
    found, _, clustered = _clustered(spark, sf_dir)
    s = E.summaries(found, clustered)
    return s.agg(F.count("*").alias("clusters"), F.sum("variants").alias("variants"), F.count_if(F.col("variants") > 1).alias("merged"), F.count_if(F.col("sources") > 1).alias("cross_source"))


@query(f"WITH RECURSIVE {CLUSTERS} SELECT canonical, count(DISTINCT source) AS sources, count(*) AS mentions FROM men JOIN clu USING (name) GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_source_entities(spark, sf_dir):
    found, _, clustered = _clustered(spark, sf_dir)
    return E.summaries(found, clustered).where("sources > 1").select("canonical", "sources", "mentions")


@query(f"WITH RECURSIVE {CLUSTERS}, q AS (SELECT id AS qid, min(query) AS query FROM interactions WHERE id % 50 = 0 AND query IS NOT NULL GROUP BY 1), t AS (SELECT DISTINCT qid, unnest(list_concat([lower(trim(query))], string_split_regex(lower(query), '\\s+'))) AS low FROM q), v AS (SELECT lower(name) AS low, max(canonical) AS canonical FROM clu GROUP BY 1) SELECT DISTINCT qid, coalesce(lower(clu.name), t.low) AS name FROM t LEFT JOIN v ON v.low = t.low LEFT JOIN clu ON clu.canonical = v.canonical WHERE t.low <> ''")
def query_entity_expand(spark, sf_dir):
    """The names in each query, with all variants of the entities among them."""
    from corpusmill.plans.retrieval_queries import queries

    clustered = _clustered(spark, sf_dir)[2]
    t = queries(spark, sf_dir).select("qid", F.explode(R.query_entities(F.col("query"))).alias("low")).where("low <> ''")
    v = clustered.groupBy(F.lower("name").alias("low")).agg(F.max("canonical").alias("canonical"))
    return t.join(v, "low", "left").join(clustered, "canonical", "left").select("qid", F.coalesce(F.lower("name"), "low").alias("name")).distinct()


@query(f"WITH RECURSIVE {INC} SELECT * FROM ver")
def entity_docfreq(spark, sf_dir):
    return G.vertices(_graph(spark, sf_dir)[2])


@query(f"WITH RECURSIVE {INC} SELECT * FROM coo")
def cooccurrence(spark, sf_dir):
    return G.cooccurrence(_graph(spark, sf_dir)[2])


@query(f"WITH RECURSIVE {INC} SELECT * FROM edg")
def npmi_edges(spark, sf_dir):
    return G.edges(_graph(spark, sf_dir)[2])


@query(f"""WITH RECURSIVE {INC}, nb AS (SELECT a AS entity, b AS neighbor, npmi, cooccur FROM edg UNION ALL SELECT b, a, npmi, cooccur FROM edg)
SELECT nb.entity, nb.neighbor, npmi, cooccur, sm.type, (row_number() OVER (PARTITION BY nb.entity ORDER BY npmi DESC, neighbor))::INTEGER AS rank FROM nb JOIN sm ON sm.canonical = nb.neighbor QUALIFY rank <= 10""")
def graph_neighbors(spark, sf_dir):
    found, clustered, pairs = _graph(spark, sf_dir)
    e = materialize(G.edges(pairs), "edges")
    return G.neighbors(e, G.both_ways(e), E.summaries(found, clustered))


def _communities(spark, sf_dir):
    def build():
        _, _, pairs = _graph(spark, sf_dir)
        v, e = materialize(G.vertices(pairs), "vertices"), materialize(G.edges(pairs), "edges")
        return v, e, materialize(G.communities(v, e), "communities")

    return once(spark, ("communities", sf_dir), build)


@query()
def communities(spark, sf_dir):
    return _communities(spark, sf_dir)[2]


@query()
def community_members(spark, sf_dir):
    """The other members of each entity's community, the ten most frequent."""
    v, _, labels = _communities(spark, sf_dir)
    return G.members(labels, v, labels, 10)


@query()
def community_bridges(spark, sf_dir):
    """Entities that connect communities."""
    v, e, labels = _communities(spark, sf_dir)
    return G.bridges(v, e, labels)


@query()
def graph_overview(spark, sf_dir):
    """Nodes, edges, communities and bridges of the graph, and its modularity."""
    v, e, labels = _communities(spark, sf_dir)
    score = G.modularity(G.both_ways(e).select("entity", "neighbor", F.col("npmi").alias("w")), labels)
    one = labels.agg(F.count("*").alias("entities"), F.countDistinct("community").alias("communities"))
    for part in (e.agg(F.count("*").alias("edges")), G.bridges(v, e, labels).agg(F.count("*").alias("bridges"))):
        one = one.join(F.broadcast(part))  # one row each
    return one.withColumn("modularity", F.round(F.lit(score), 6))


LABELS = CLUSTERS + ", ce AS (SELECT DISTINCT chunk_key, canonical AS entity FROM men JOIN clu USING (name))"


@query(f"""WITH RECURSIVE {LABELS}, m AS (SELECT t.chunk_key, r.chunk_key AS related_key, count(*) AS match_count FROM ce t JOIN ce r ON t.entity = r.entity AND t.chunk_key <> r.chunk_key WHERE t.chunk_key % 50 = 0 GROUP BY ALL)
SELECT chunk_key, related_key, match_count, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_key ORDER BY match_count DESC, related_key) AS rank FROM m) WHERE rank <= 10""")
def find_related(spark, sf_dir):
    """The ten chunks that share the most entities, whatever their spelling, with each queried chunk."""
    found, _, clustered = _clustered(spark, sf_dir)
    items = materialize(E.labels_of(found, clustered), "chunk-entities")
    targets = items.where("chunk_key % 50 = 0").select(F.col("chunk_key").alias("target"), F.col("entities").alias("wanted"))
    return R.related(items, "chunk_key", "entities", targets, "target", "wanted", 10).select(F.col("target").alias("chunk_key"), F.col("chunk_key").alias("related_key"), "match_count", "rank")


HOT = "open_studio_archive"


@query(f"""WITH RECURSIVE {LABELS}, t AS (SELECT id AS qid, name FROM (SELECT id, min(query) AS query FROM interactions WHERE id % 50 = 0 AND query IS NOT NULL GROUP BY 1) q JOIN clu ON contains(lower(query), lower(name)) AND length(name) > 3),
v AS (SELECT lower(name) AS low, max(canonical) AS canonical FROM clu GROUP BY 1), w AS (SELECT DISTINCT qid, canonical FROM t JOIN v ON v.low = lower(t.name)),
m AS (SELECT qid, ce.chunk_key, count(*) AS match_count FROM w JOIN ce ON ce.entity = w.canonical JOIN {CHUNKS} c ON c.chunk_key = ce.chunk_key AND c.collection = '{HOT}' GROUP BY ALL)
SELECT qid, chunk_key, match_count, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY match_count DESC, chunk_key) AS rank FROM m) WHERE rank <= 10""")
def find_related_entities(spark, sf_dir):
    """For the entities named in each query: the ten chunks of one collection that mention the most of them."""
    from corpusmill.plans.retrieval_queries import queries

    found, _, clustered = _clustered(spark, sf_dir)
    named = R.contains_search(queries(spark, sf_dir).select("qid", "query"), "qid", "query", clustered.where(F.length("name") > 3), "name", "name")
    known = E.resolve(named, "name", clustered, fuzzy=False, fold=True)
    targets = named.join(known, "name").where("canonical IS NOT NULL").groupBy("qid").agg(F.collect_set("canonical").alias("wanted"))
    items = E.labels_of(found, clustered).join(chunks(spark, sf_dir).where(F.col("collection") == HOT).select("chunk_key"), "chunk_key", "left_semi")
    return R.related(items, "chunk_key", "entities", targets.select(F.concat(F.lit("q"), F.col("qid")).alias("target"), "wanted"), "target", "wanted", 10).select(F.substring("target", 2, 20).cast("long").alias("qid"), "chunk_key", "match_count", "rank")


@query(f"WITH RECURSIVE {INC}, w AS (SELECT nbr.entity, count(DISTINCT CASE WHEN o.type <> s.type THEN o.type END) AS k, count(*) AS degree FROM nbr JOIN sm s ON s.canonical = nbr.entity JOIN sm o ON o.canonical = nbr.neighbor GROUP BY 1) SELECT entity, k + 1 AS communities_bridged, degree FROM w WHERE k >= 2")
def graph_bridges(spark, sf_dir):
    """Bridges between entity types, taken as fixed communities."""
    found, clustered, pairs = _graph(spark, sf_dir)
    labels = E.summaries(found, clustered).select(F.col("canonical").alias("entity"), F.col("type").alias("community"))
    return G.bridges(G.vertices(pairs), G.edges(pairs), labels)


@query(f"""WITH RECURSIVE {CLUSTERS}, k AS (SELECT canonical, any_value(type) AS type, sum(n)::BIGINT AS mentions FROM (SELECT canonical, arg_min(type, struct_pack(a := -n, b := type)) AS type, sum(n) AS n FROM (SELECT canonical, type, count(*) AS n FROM men JOIN clu USING (name) GROUP BY ALL) GROUP BY 1) GROUP BY 1)
SELECT type, count(*) AS clusters, sum(mentions)::BIGINT AS mentions, arg_min(canonical, struct_pack(a := -mentions, b := canonical)) AS top_entity FROM k GROUP BY 1""")
def entity_types(spark, sf_dir):
    """How many entities each type has, and the one of most mentions."""
    found, _, clustered = _clustered(spark, sf_dir)
    s = E.summaries(found, clustered)
    return s.groupBy("type").agg(F.count("*").alias("clusters"), F.sum("mentions").alias("mentions"), F.min_by("canonical", F.struct(-F.col("mentions"), F.col("canonical"))).alias("top_entity"))


@query(f"WITH RECURSIVE {CLUSTERS} SELECT canonical, count(DISTINCT source) AS sources, count(*) AS mentions FROM men JOIN clu USING (name) GROUP BY 1 ORDER BY mentions DESC, canonical LIMIT 20")
def top_entities(spark, sf_dir):
    """The twenty entities of most mentions."""
    found, _, clustered = _clustered(spark, sf_dir)
    return E.summaries(found, clustered).select("canonical", "sources", "mentions").orderBy(F.col("mentions").desc(), "canonical").limit(20)


@query(f"WITH RECURSIVE {INC} SELECT (SELECT count(*) FROM ver) AS entities, (SELECT count(*) FROM edg) AS edges, (SELECT n::BIGINT FROM num) AS chunks")
def graph_stats(spark, sf_dir):
    _, _, pairs = _graph(spark, sf_dir)
    v = pairs.agg(F.countDistinct("entity").alias("entities"), F.countDistinct("chunk_key").alias("chunks"))
    return v.join(F.broadcast(G.edges(pairs).agg(F.count("*").alias("edges"))))  # one row each
