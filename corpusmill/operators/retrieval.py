"""Batch retrieval: vectors, BM25, fusion, boosts and context, for many queries in one plan."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import store
from corpusmill.session import materialize, spread

# Words that the inverted index leaves out.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
K1, B = 1.2, 0.75
RRF_K = 60
CANDIDATES = 30
#: Query vectors, and texts of queries, of one broadcast block; more queries make more blocks.
QUERY_BLOCK, TEXT_BLOCK = 1024, 50_000
#: Rows whose scores are held at once, and partial scores of a step.
SCORE_ROWS, SCORE_CELLS = 2048, 2_000_000
#: Least relevance of a multi-hop result, and parts of a rating that move a score.
RELEVANT, RATING_WEIGHT = 0.1, 0.1
#: Reach of the text around a result: seconds, or chunks.
PARENT_SECONDS, PARENT_CHUNKS = 150, 2


def ranked(df: DataFrame, by: str, score: str, key: str, most: int | None = None) -> DataFrame:
    """rank (from 1) within each query, by score and then key; Spark prunes to ``most`` before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(key))
    out = df.withColumn("rank", F.row_number().over(w))
    return out if most is None else out.where(F.col("rank") <= most)


def vector_search(rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, most: int, keep: Column | None = None) -> DataFrame:
    """query_key, key, score and rank of the nearest rows of each query by cosine, exact over all rows.

    Queries are taken in blocks of ``QUERY_BLOCK``, so a block's size is bounded; each Arrow batch of rows
    gives its own best ``most`` of every query, and only those are shuffled. Null vectors are skipped; vectors of zeros score 0. Scores are rounded to 6 places; ties go to the smaller key.
    """
    spark = rows.sparkSession
    kinds = queries.schema[query_key].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    schema = f"{query_key} {kinds[0]}, {key} {kinds[1]}, score double"
    data = rows if keep is None else rows.where(keep)
    data = data.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    out: DataFrame | None = None
    for ids, matrix in _blocks(queries.where(F.col(query_vector).isNotNull()).select(query_key, query_vector)):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for b in (whole.slice(k, SCORE_ROWS) for whole in batches for k in range(0, whole.num_rows, SCORE_ROWS)):
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                scores = np.round(_unit(flat.reshape(b.num_rows, -1)) @ q.T, 6) + 0.0
                floor = np.partition(scores, max(0, len(scores) - most), axis=0)[max(0, len(scores) - most)]
                row, col = np.nonzero(scores >= floor)
                yield pa.record_batch([names.take(pa.array(col)), b.column(0).take(pa.array(row)), pa.array(scores[row, col])], [query_key, key, "score"])

        part = data.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, query_key, "score", key, most)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def _blocks(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    ids, vectors = [], []
    kind = pa.int64() if queries.schema[0].dataType.simpleString() in ("bigint", "int") else None
    for r in queries.toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == QUERY_BLOCK:
            yield pa.array(ids, kind), _unit(np.array(vectors, np.float64))
            ids, vectors = [], []
    if ids:
        yield pa.array(ids, kind), _unit(np.array(vectors, np.float64))


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, stop words dropped."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: ~t.isin(STOP_WORDS))


_TERM = re.compile("[a-z0-9]+")
_STOP = frozenset(STOP_WORDS)


def terms_of(text: str) -> list[str]:
    """``terms`` of a text inside a worker."""
    return [t for t in _TERM.findall(text.lower()) if t not in _STOP]


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf and dl (terms of the document): the inverted index. Null texts have no terms. Counted within each text, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, SCORE_ROWS) for whole in batches for k in range(0, whole.num_rows, SCORE_ROWS)):
            rows, found, tf, dl = [], [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                t = terms_of(x)
                counts = Counter(t)
                rows += [i] * len(counts)
                found += counts.keys()
                tf += counts.values()
                dl += [len(t)] * len(counts)
            yield pa.record_batch([pa.array(found, pa.string()), b.column(0).take(pa.array(rows, pa.int64())), pa.array(dl, pa.int32()), pa.array(tf, pa.int64())], ["term", key, "dl", "tf"])

    return docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"term string, {key} {_kind(docs, key)}, dl int, tf long")


def update_postings(path: str, chunks: DataFrame, text: str = "text") -> None:
    """Bring the stored inverted index up to date for the episodes of ``chunks``: only the parts that hold them are rewritten, as in the store of chunks. A row has collection, episode_num, term, chunk_key, dl and tf."""
    where = chunks.select("chunk_key", "collection", "episode_num")
    store.replace_episodes(path, postings(chunks, "chunk_key", text).join(where, "chunk_key"))


class TermBlock:
    """The distinct terms of a block of queries, and which queries have each."""

    def __init__(self, queries: list[tuple[Any, list[str]]], kind: pa.DataType | None):
        self.ids = pa.array([q for q, _ in queries], kind)
        self.number: dict[str, int] = {}
        pairs = sorted((self.number.setdefault(t, len(self.number)), i) for i, (_, ts) in enumerate(queries) for t in set(ts))
        self.owners = np.array([i for _, i in pairs], np.int64)
        self.offsets = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.number) + 1))

    def scores(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, sum of weights, to 6 places) of all queries that share terms with rows (in order), the best ``most`` of each step with their ties."""
        n = self.offsets[terms + 1] - self.offsets[terms]
        ends = np.cumsum(n)
        cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1], True]) if len(rows) else np.zeros(1, np.int64)
        a = 0
        while a < len(cuts) - 1:  # whole rows only, about SCORE_CELLS at once
            done = ends[cuts[a] - 1] if cuts[a] else 0
            b = max(a + 1, int(np.searchsorted(ends[cuts[1:] - 1], done + SCORE_CELLS, "right")))
            part = slice(cuts[a], cuts[b])
            rep = np.repeat(np.arange(cuts[a], cuts[b]), n[part])
            at = np.arange(len(rep)) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + self.offsets[terms[rep]]
            wide = int(rows.max()) + 1
            code = self.owners[at] * wide + rows[rep]
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0]) if len(code) else np.zeros(0, np.int64)
            score = np.round(np.add.reduceat(weights[rep][order], first), 6) if len(first) else np.zeros(0)
            owner, row = np.divmod(code[order][first], wide)
            if most is not None and len(owner):
                order = np.lexsort((-score, owner))
                owner, row, score = owner[order], row[order], score[order]
                begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                size = np.diff(np.r_[begin, len(owner)])
                keep = score >= np.repeat(score[begin + np.minimum(size, most) - 1], size)
                owner, row, score = owner[keep], row[keep], score[keep]
            yield owner, row, score
            a = b


def _term_blocks(queries: DataFrame, query_key: str, column: str) -> Iterator[TermBlock]:
    """Blocks of queries (query_key, array of terms); queries pass the driver one by one."""
    kind = pa.int64() if _kind(queries, query_key) in ("bigint", "int") else None
    held: list[tuple[Any, list[str]]] = []
    for r in queries.select(query_key, column).toLocalIterator():
        held.append((r[0], r[1] or []))
        if len(held) == TEXT_BLOCK:
            yield TermBlock(held, kind)
            held = []
    if held:
        yield TermBlock(held, kind)


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str, most: int | None = CANDIDATES) -> DataFrame:
    """query_key, key, score and rank by BM25 with statistics of all documents.

    Texts are read once for each block of queries: every text's counts of the queries' terms are written out, a row a text, and statistics and scores come from those. A
    task sends only its best ``most`` for each query, so neither postings nor a frequent term's documents are shuffled. Scores are rounded to 6 places; ties go to the smaller key.
    """
    spark = docs.sparkSession
    schema = f"{query_key} {_kind(queries, query_key)}, {key} {_kind(docs, key)}, score double"
    wanted = queries.where(F.col(query).isNotNull()).select(query_key, terms(F.col(query)).alias("t"))
    d = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("x")))
    out: DataFrame | None = None
    for block in _term_blocks(wanted, query_key, "t"):
        held = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            number = held.value.number
            for b in batches:
                dl, found, tf = [], [], []
                for x in b.column(1).to_pylist():
                    t = terms_of(x)
                    counts = Counter(number[w] for w in t if w in number)
                    dl.append(len(t))
                    found.append(list(counts.keys()))
                    tf.append(list(counts.values()))
                yield pa.record_batch([b.column(0), pa.array(dl, pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["k", "dl", "t", "tf"])

        hits = materialize(d.mapInArrow(count, f"k {_kind(docs, key)}, dl int, t array<int>, tf array<int>"), "text-hits")
        n, average = hits.agg(F.count("*"), F.avg("dl")).first()
        idf = np.zeros(len(block.number))
        for term, df in hits.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*")).toLocalIterator():  # a row a term of the block
            idf[term] = math.log(1 + (n - df + 0.5) / (df + 0.5))
        stats = spark.sparkContext.broadcast((idf, average or 1.0))

        def score(batches: Iterator[pa.RecordBatch], held=held, stats=stats) -> Iterator[pa.RecordBatch]:
            block, (idf, average) = held.value, stats.value
            for b in batches:
                t, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                rows = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
                dl = b.column(1).to_numpy(zero_copy_only=False)[rows]
                weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))
                for owner, row, s in block.scores(rows, t, weight, most):
                    yield pa.record_batch([block.ids.take(pa.array(owner)), b.column(0).take(pa.array(row)), pa.array(s)], [query_key, key, "score"])

        part = hits.where(F.size("t") > 0).mapInArrow(score, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, query_key, "score", key, most)


def related(items: DataFrame, key: str, labels_: str, targets: DataFrame, target_key: str, wanted: str, most: int = 10) -> DataFrame:
    """target_key, key, match_count and rank of the items that share the most labels (arrays of text) with each target; an item isn't related to itself where both keys are of one type.

    Targets are taken in blocks; a task counts matches for all of them and sends its best ``most`` of each, so a label of most items makes no large join. Ties go to the smaller key.
    """
    spark = items.sparkSession
    schema = f"{target_key} {_kind(targets, target_key)}, {key} {_kind(items, key)}, match_count double"
    d = items.where(F.size(labels_) > 0).select(F.col(key).alias("k"), F.array_distinct(labels_).alias("l"))
    out: DataFrame | None = None
    for block in _term_blocks(targets, target_key, wanted):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            for b in batches:
                known = [(i, block.number[x]) for i, ls in enumerate(b.column(1).to_pylist()) for x in ls if x in block.number]
                rows, t = (np.array(c, np.int64) for c in zip(*known)) if known else (np.zeros(0, np.int64),) * 2
                for owner, row, s in block.scores(rows, t, np.ones(len(t)), most + 1):
                    yield pa.record_batch([block.ids.take(pa.array(owner)), b.column(0).take(pa.array(row)), pa.array(s)], [target_key, key, "match_count"])

        part = d.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    out = out.withColumn("match_count", F.col("match_count").cast("long"))
    if _kind(targets, target_key) == _kind(items, key):
        out = out.where(F.col(target_key) != F.col(key))
    return ranked(out, target_key, "match_count", key, most)


def contains_search(rows: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str) -> DataFrame:
    """query_key and key of the rows whose text contains the query, whatever the case; queries are taken in blocks of bounded size."""
    low = rows.where(F.col(text).isNotNull()).select(key, F.lower(text).alias("__text"))
    wanted = queries.where(F.col(query).isNotNull()).select(query_key, F.lower(query).alias("q"))
    schema = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}"
    out, block = rows.sparkSession.createDataFrame([], schema), []

    def search(block: list) -> DataFrame:
        held = F.array(*(F.struct(F.lit(r[0]).alias("id"), F.lit(r[1]).alias("q")) for r in block))
        hits = F.filter(held, lambda x: F.contains(F.col("__text"), x["q"]))
        return low.select(key, F.explode(hits).alias("x")).select(F.col("x.id").alias(query_key), key)

    for r in wanted.toLocalIterator():
        block.append(r)
        if len(block) == 256:
            out, block = out.unionByName(search(block)), []
    return out.unionByName(search(block)) if block else out


def fuse(lists: list[DataFrame], query_key: str, key: str, k: int = RRF_K) -> DataFrame:
    """query_key, key and the reciprocal-rank score of several ranked lists, rounded to 8 places; an item repeated in a list adds again."""
    union = lists[0].select(query_key, key, "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select(query_key, key, "rank"))
    return union.groupBy(query_key, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"))


def entity_names(c: Column) -> Column:
    """Lower-cased names in a JSON array of objects; anything else has none."""
    names = F.transform(F.from_json(c, "array<string>"), lambda e: F.lower(F.get_json_object(e, "$.name")))
    return F.coalesce(F.filter(names, lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>"))


def labels(rows: DataFrame) -> Column:
    """All names, keywords and concept tags of a chunk, once each."""
    return F.array_distinct(F.concat(entity_names(F.col("entities")), T.tag_list(F.col("keywords")), T.tag_list(F.col("concept_tags"))))


def query_entities(query: Column) -> Column:
    """The default recogniser for queries: the query and its words, lower-cased. Others may be plugged in as a column of arrays."""
    return F.array_distinct(F.concat(F.array(F.lower(T.strip(query))), T.words(F.lower(query))))


def recognized(queries: DataFrame, query_key: str, query: str, recognizer: Any, variants: DataFrame | None = None) -> DataFrame:
    """query_key and asked: the lower-cased names that a ``Recognizer`` finds in each query, with all variants (name, canonical) of the entities among them.

    A query on which the recogniser fails has none."""
    held = queries.sparkSession.sparkContext.broadcast(recognizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for q in b.column(1).to_pylist():
                try:
                    found.append(sorted({name.lower() for name, _ in held.value.entities(q or "")}))
                except Exception:  # without a recogniser the search goes on
                    found.append([])
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.string()))], [query_key, "asked"])

    asked = queries.select(query_key, query).mapInArrow(run, f"{query_key} {_kind(queries, query_key)}, asked array<string>")
    if variants is None:
        return asked
    known = variants.select(F.lower("name").alias("low"), "canonical")
    named = asked.select(query_key, F.explode("asked").alias("low"))
    more = named.join(known, "low").join(known.select("canonical", F.col("low").alias("variant")), "canonical").select(query_key, F.col("variant").alias("low"))
    return named.unionByName(more).groupBy(query_key).agg(F.array_sort(F.collect_set("low")).alias("asked"))


def entity_rank(candidates: DataFrame, query_key: str, key: str, query_set: str, label_set: str) -> DataFrame:
    """Candidates that share labels with the query, ranked by how many: query_key, key, overlap, rank."""
    found = candidates.select(query_key, key, F.size(F.array_intersect(query_set, label_set)).alias("overlap")).where("overlap > 0")
    return ranked(found, query_key, "overlap", key)


def wilson(good: Column, bad: Column, z: float = 1.96) -> Column:
    """Lower bound of the share of good ones; 0.5 without data."""
    n = (good + bad).cast("double")
    p = good / n
    return F.when(n == 0, 0.5).otherwise((p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n))


def boosted(score: Column, rated: Column, weight: float = RATING_WEIGHT) -> Column:
    """A score moved by a chunk's ratings (columns fetches, ignores, explicit_up, explicit_down; null if unrated) and importance."""
    w = wilson(F.col("fetches") + 3 * F.col("explicit_up"), F.col("ignores") + 3 * F.col("explicit_down"))
    importance = F.greatest(F.lit(1), F.least(F.lit(5), F.col("importance")))
    by_importance = F.when(F.coalesce(F.col("importance"), F.lit(3)).isin(0, 3), 0.0).otherwise(weight * 0.5 * (importance - 3) / 2)
    return score + F.when(rated, weight * (w - 0.5)).otherwise(0.0) + by_importance


def moved_by_ratings(results: DataFrame, chunks: DataFrame, ratings: DataFrame) -> DataFrame:
    """The results (qid, chunk_key, score, rank) with scores moved by ratings (chunk_id and counts) and importance, ranked anew among themselves; ties keep their order."""
    own = chunks.select("chunk_key", "id", "importance")
    both = results.withColumnRenamed("rank", "was").join(own, "chunk_key").join(ratings.withColumnRenamed("chunk_id", "id"), "id", "left")
    return ranked(both.withColumn("score", F.round(boosted(F.col("score"), F.col("fetches").isNotNull()), 6)), "qid", "score", "was").select("qid", "chunk_key", "score", "rank")


def decayed(results: DataFrame, chunks: DataFrame, seen: DataFrame, factor: float = 0.5) -> DataFrame:
    """The results with the scores of chunks that the asking session has fetched (seen: qid, chunk_id) lowered, ranked anew; ties keep their order."""
    marks = seen.select("qid", F.col("chunk_id").alias("id"), F.lit(True).alias("__seen")).distinct()
    both = results.withColumnRenamed("rank", "was").join(chunks.select("chunk_key", "id"), "chunk_key").join(marks, ["qid", "id"], "left")
    return ranked(both.withColumn("score", F.when(F.col("__seen"), F.col("score") * factor).otherwise(F.col("score"))), "qid", "score", "was").select("qid", "chunk_key", "score", "rank")


def reranked(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, reranker: Any, most: int) -> DataFrame:
    """The best ``most`` candidates (qid, chunk_key, score, rank) of each query by a ``Reranker`` on their texts, scores to 4 places; ties keep their order.

    Where the reranker fails, the candidates keep their order with score 1. A query's candidates are few; they're streamed from sorted partitions."""
    held = candidates.sparkSession.sparkContext.broadcast(reranker)
    rows = candidates.select("qid", "chunk_key", "rank").join(queries.select("qid", "query"), "qid").join(chunks.select("chunk_key", "text"), "chunk_key")

    def fold(key, group):
        listed = list(group)
        try:
            scores = [float(x) for x in held.value.score(listed[0][2], [r[3] or "" for r in listed])]
            if len(scores) != len(listed):
                raise ValueError("a score for each text is needed")
        except Exception:  # no reranker, no reordering
            scores = [1.0] * len(listed)
        for r, s in zip(listed, scores):
            yield (*key, r[0], round(s, 4), r[1])

    scored = store.streamed(rows, ["qid"], ["rank"], ["chunk_key", "rank", "query", "text"], f"qid {_kind(candidates, 'qid')}, chunk_key {_kind(candidates, 'chunk_key')}, score double, was int", fold)
    return ranked(scored, "qid", "score", "was", most).select("qid", "chunk_key", "score", "rank")


def expand(results: DataFrame, result_key: str, chunks: DataFrame, by: str, reach: int) -> DataFrame:
    """result_key and the text of each result's neighbourhood: chunks within ``reach`` in order, joined by blank lines.

    By start_sec, chunks with the same start and end count once, and start_sec and end_sec of the whole come with it; by chunk_index, a result with no neighbours keeps its own text.
    A neighbourhood is small: it's bounded by the reach.
    """
    columns = ["chunk_key", "collection", "episode_num", "start_sec", "end_sec", "chunk_index", "text"]
    near = store.neighbors(results, chunks.select(*columns), by, reach)
    if by == "start_sec":
        spans = near.groupBy(result_key, "r_start_sec", "r_end_sec").agg(F.min_by("r_text", "r_chunk_key").alias("text"))
        parts = spans.groupBy(result_key).agg(F.array_sort(F.collect_list(F.struct("r_start_sec", "r_end_sec", "text"))).alias("p"))
        text = F.array_join(F.transform("p", lambda p: p["text"]), "\n\n")
        return parts.select(result_key, text.alias("text"), F.element_at("p", 1)["r_start_sec"].alias("start_sec"), F.element_at("p", -1)["r_end_sec"].alias("end_sec"))
    parts = near.groupBy(result_key).agg(F.array_sort(F.collect_list(F.struct("r_chunk_index", "r_chunk_key", "r_text"))).alias("p"))
    return parts.select(result_key, F.array_join(F.transform("p", lambda p: p["r_text"]), "\n\n").alias("text"))


def with_context(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, chunk_key, score, rank, text, start_sec and end_sec of results with the text around them: by time if a chunk has a place in time, else by index."""
    at = chunks.select("chunk_key", "collection", "episode_num", "start_sec", "end_sec", "chunk_index")
    hits = results.select("chunk_key").distinct().join(at, "chunk_key")
    timed = (F.col("start_sec") > 0) | (F.col("end_sec") > 0)
    by_time = expand(hits.where(timed).drop("end_sec", "chunk_index"), "chunk_key", chunks, "start_sec", PARENT_SECONDS)
    by_index = expand(hits.where(~timed).drop("start_sec", "end_sec"), "chunk_key", chunks, "chunk_index", PARENT_CHUNKS).select("chunk_key", "text", F.lit(0).alias("start_sec"), F.lit(0).alias("end_sec"))
    return results.join(by_time.unionByName(by_index), "chunk_key").select("qid", "chunk_key", "score", "rank", "text", "start_sec", "end_sec")


def of_topic(topic: str | None = None, subtopic: str | None = None) -> Column | None:
    """The filter of a topic and a subtopic, which are stored in lower case; None for neither."""
    parts = [F.col(c) == v.lower() for c, v in (("topic", topic), ("subtopic", subtopic)) if v]
    return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]


def search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, most: int = 5, where: Column | None = None, reranker: Any = None, ratings: DataFrame | None = None, seen: DataFrame | None = None, around: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """The search pipeline for a table of queries (qid, query, vector): qid, chunk_key, score, rank, and text, start_sec, end_sec if ``around``.

    Vectors (chunk_key, vector) and BM25 give 30 candidates each, from chunks that meet ``where`` (see ``of_topic``); labels shared with the query's entities (``asked``: qid, asked; by default its words)
    rank the candidates once more; ranks are fused, the best ``4 * most`` are reranked by a ``Reranker`` (by default their order stands with score 1). The best ``most`` are moved by ratings and importance, then lowered if the session has
    ``seen`` them (qid, chunk_id), and given with the text around them.
    """
    kept = chunks if where is None else chunks.where(where)
    by_vector = vector_search(kept.select("chunk_key").join(vectors, "chunk_key"), "chunk_key", "vector", queries, "qid", "vector", CANDIDATES)
    by_text = bm25(chunks, "chunk_key", "text", queries, "qid", "query", None if where is not None else CANDIDATES)
    if where is not None:  # statistics are those of all chunks; the filter comes before the best are taken
        by_text = ranked(by_text.drop("rank").join(kept.select("chunk_key"), "chunk_key", "left_semi"), "qid", "score", "chunk_key", CANDIDATES)
    both = [materialize(x.select("qid", "chunk_key", "rank"), "search-hits") for x in (by_vector, by_text)]
    found = both[0].select("qid", "chunk_key").unionByName(both[1].select("qid", "chunk_key")).distinct()
    sets = kept.join(found.select("chunk_key").distinct(), "chunk_key", "left_semi")  # only candidates' JSON is parsed
    sets = sets.select("chunk_key", labels(sets).alias("labels"))
    asked = queries.select("qid", query_entities(F.col("query")).alias("asked")) if asked is None else asked
    by_label = entity_rank(found.join(asked, "qid").join(sets, "chunk_key"), "qid", "chunk_key", "asked", "labels")
    fused = ranked(fuse([*both, by_label], "qid", "chunk_key"), "qid", "score", "chunk_key", 4 * most)
    best = reranked(fused, chunks, queries, reranker, most) if reranker is not None else fused.withColumn("score", F.lit(1.0)).where(F.col("rank") <= most)
    if ratings is not None:
        best = moved_by_ratings(best, chunks, ratings)
    if seen is not None:
        best = decayed(best, chunks, seen)
    return with_context(best, chunks) if around else best


def decomposed(queries: DataFrame, provider: Any, most: int = 4) -> DataFrame:
    """qid, hop and query: what a ``Provider`` makes of each question. A question that it can't cut, or fails on, has none."""
    held = queries.sparkSession.sparkContext.broadcast(provider)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies = []
            for q in b.column(1).to_pylist():
                try:
                    replies.append(held.value.chat([{"role": "user", "content": f"Split into at most {most} search queries, one a line:\n{q}"}]))
                except Exception:  # falls back to a plain search
                    replies.append(None)
            yield pa.record_batch([b.column(0), pa.array(replies, pa.string())], ["qid", "reply"])

    replies = queries.select("qid", "query").mapInArrow(run, f"qid {_kind(queries, 'qid')}, reply string")
    return replies.where("reply IS NOT NULL").select("qid", F.posexplode(T.query_lines(F.col("reply"), most)).alias("hop", "query"))


def multi_hop(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, sub_queries: DataFrame, most: int = 5, where: Column | None = None, reranker: Any = None, ratings: DataFrame | None = None, seen: DataFrame | None = None, around: bool = False) -> DataFrame:
    """``search`` for questions (qid, query, vector) cut into sub-queries (qid, hop, query, vector).

    All sub-queries run in one plan, each for at least five results; their lists are fused per question, and the best ``4 * most`` reranked on the question itself, ``2 * most`` of them kept. Those of at least ``RELEVANT`` stand, or
    all if none is; the first ``most`` are given, with the text around them once. A question with fewer than two sub-queries, or without any result, is searched plainly.
    """
    cut = sub_queries.groupBy("qid").agg(F.count("*").alias("hops")).where("hops > 1").select("qid")
    several = sub_queries.join(cut, "qid", "left_semi")
    mark = F.struct("qid", "hop")
    each = several.select(F.to_json(mark).alias("qid"), "query", "vector")
    own = None if seen is None else several.select(F.to_json(mark).alias("sub"), "qid").join(seen, "qid").select(F.col("sub").alias("qid"), "chunk_id")
    parts = search(chunks, vectors, each, max(most, 5), where, reranker, ratings, own)
    parent = F.from_json("qid", f"qid {_kind(questions, 'qid')}")["qid"]  # cheaper than a join back
    lists = materialize(parts.select(parent.alias("qid"), "chunk_key", "rank"), "hops")
    fused = ranked(fuse([lists], "qid", "chunk_key"), "qid", "score", "chunk_key", 4 * most)
    best = reranked(fused, chunks, questions, reranker, 2 * most) if reranker is not None else fused.withColumn("score", F.lit(1.0)).where(F.col("rank") <= 2 * most)
    best = best.withColumn("__fit", F.max(F.col("score") >= RELEVANT).over(Window.partitionBy("qid")))
    best = ranked(best.where(~F.col("__fit") | (F.col("score") >= RELEVANT)).withColumnRenamed("rank", "was"), "qid", "score", "was", most).select("qid", "chunk_key", "score", "rank")
    plain = questions.join(lists.select("qid").distinct(), "qid", "left_anti")
    if not plain.isEmpty():
        best = best.unionByName(search(chunks, vectors, plain, most, where, reranker, ratings, seen))
    return with_context(best, chunks) if around else best


def context(targets: DataFrame, chunks: DataFrame, seen: DataFrame | None = None, page_tokens: int = 1500) -> DataFrame:
    """What stands before, after or around targets, in pages: tid, chunk_key, tokens, place (from 1) and page (from 1).

    A target (tid, collection, episode_num, start_sec, end_sec, chunk_index, direction, amount) with a place in time takes ``amount`` seconds, half to either side if "around"; others take a chunk for each minute, two at least, to each side.
    ``timed`` may be a column of its own, for targets given by time only. Chunks that the session has fetched (``seen``: tid, chunk_id) are left out before pages are cut; all pages come out, so a reader of page 2 isn't confused by what page 1 fetched.
    """
    timed = F.col("timed") if "timed" in targets.columns else (F.col("start_sec") > 0) | (F.col("end_sec") > 0)
    t = targets.select("tid", "collection", "episode_num", "start_sec", "chunk_index", "direction", "amount", timed.alias("timed"))
    rows = chunks.select("chunk_key", "id", "collection", "episode_num", "start_sec", "chunk_index", T.token_estimate(F.col("text")).alias("tokens"))
    before, after = F.col("direction") == "before", F.col("direction") == "after"
    wide = F.when(before | after, F.col("amount")).otherwise(F.floor(F.col("amount") / 2))
    steps = F.greatest(F.lit(2), F.floor(F.col("amount") / 60))
    parts = []
    for of, at, reach, width in ((F.col("timed"), "start_sec", wide, 300), (~F.col("timed"), "chunk_index", steps, 8)):
        low = F.when(after, F.col(at)).otherwise(F.greatest(F.lit(0), F.col(at) - reach))
        high = F.when(before, F.col(at)).otherwise(F.col(at) + reach)
        parts.append(store.band_join(t.where(of), rows, ["collection", "episode_num"], at, low, high, width).select("tid", F.col("r_chunk_key").alias("chunk_key"), F.col("r_id").alias("id"), F.col("r_start_sec").alias("start_sec"), F.col("r_chunk_index").alias("chunk_index"), F.col("r_tokens").alias("tokens")))
    near = parts[0].unionByName(parts[1])
    if seen is not None:
        near = near.join(seen.select("tid", F.col("chunk_id").alias("id")).distinct(), ["tid", "id"], "left_anti")

    def fold(key, group):
        place = filled = items = 0
        page = 1
        for chunk, size in group:
            if page_tokens and items and filled + size > page_tokens:
                page, filled, items = page + 1, 0, 0
            place, filled, items = place + 1, filled + size, items + 1
            yield (*key, chunk, size, place, page)

    return store.streamed(near, ["tid"], ["start_sec", "chunk_index", "chunk_key"], ["chunk_key", "tokens"], f"tid {_kind(targets, 'tid')}, chunk_key {_kind(chunks, 'chunk_key')}, tokens int, place int, page int", fold)


def result_overlap(a: DataFrame, b: DataFrame, query_key: str, key: str) -> DataFrame:
    """query_key and the percentage of the first ranking's results that the second has too."""
    both = a.select(query_key, key).join(b.select(query_key, key).withColumn("__hit", F.lit(1)), [query_key, key], "left")
    return both.groupBy(query_key).agg(F.round(100.0 * F.count("__hit") / F.count("*"), 4).alias("overlap"))
