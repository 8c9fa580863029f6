"""The chunk table: scans, neighbours, tables of contents, ingest deduplication and deletes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.functions import text as T
from corpusmill.session import materialize

# The columns of a metadata scan and of a compact result.
METADATA = "id title summary entities keywords concept_tags importance collection episode_title source_type section_heading chapter".split()
COMPACT = "collection collection_display episode_title source_type title summary keywords concept_tags importance".split()


def heading_of() -> Column:
    """The section heading, else the chapter, else an empty text."""
    return F.coalesce(F.nullif(F.col("section_heading"), F.lit("")), F.col("chapter"), F.lit(""))


def streamed(df: DataFrame, keys: list[str], order: list[str], values: list[str], schema: str, fold: Callable[[tuple, Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Rows of ``fold(key, values in order)`` for every key, over sorted partitions: a key's rows
    are streamed, never held, so a key of any size fits in memory."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *values)
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], names=arrow.names)

        out: list[tuple] = []
        for key, group in groupby(stream(), lambda r: r[:n]):
            for row in fold(key, (r[n:] for r in group)):
                out.append(row)
                if len(out) >= 5_000:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return rows.mapInArrow(run, schema)


def pages(df: DataFrame, keys: list[str], order: list[str], item: str, tokens: str, page_tokens: int) -> DataFrame:
    """keys, item and page (from 1): items packed in order, a new page when the next would pass ``page_tokens`` and the page isn't empty."""

    def fold(key, rows):
        page, filled, items = 1, 0, 0
        for name, size in rows:
            if items and filled + size > page_tokens:
                page, filled, items = page + 1, 0, 0
            filled, items = filled + size, items + 1
            yield (*key, name, page)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, item]) + ", page int"
    return streamed(df, keys, order, [item, tokens], schema, fold)


def band_join(targets: DataFrame, rows: DataFrame, keys: list[str], at: str, low: Column, high: Column, width: int) -> DataFrame:
    """Targets with the rows of equal keys whose ``at`` is in [low, high] (columns of the target).

    The range is cut into cells of ``width``, so the join is an equi-join on keys and cell, and a hot key is spread over its cells. Row columns
    come with the prefix ``r_``.
    """
    cells = F.explode(F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long")))
    left = targets.withColumns({"__low": low, "__high": high}).where("__high >= __low").withColumn("__cell", cells)
    right = rows.select(*(F.col(c).alias(f"r_{c}") for c in rows.columns)).withColumn("__rcell", F.floor(F.col(f"r_{at}") / width).cast("long"))
    on = [F.col(k) == F.col(f"r_{k}") for k in keys] + [F.col("__cell") == F.col("__rcell"), F.col(f"r_{at}").between(F.col("__low"), F.col("__high"))]
    return left.join(right, on).drop("__low", "__high", "__cell", "__rcell")


def neighbors(targets: DataFrame, chunks: DataFrame, by: str, reach: int) -> DataFrame:
    """Each target with the chunks of its episode within ``reach`` of its place; ``by`` is start_sec or chunk_index."""
    low, high = F.greatest(F.lit(0), F.col(by) - reach), F.col(by) + reach
    return band_join(targets, chunks, ["collection", "episode_num"], by, low, high, max(4, 2 * reach))


def list_collections(chunks: DataFrame) -> DataFrame:
    """topic, subtopic, collection, collection_display, episode_count and episodes ("number:title", joined by "|", in order)."""
    keys = ["topic", "subtopic", "collection", "collection_display"]
    episodes = chunks.select(*keys, "episode_num", "episode_title").distinct()
    listed = F.array_sort(F.collect_list(F.struct("episode_num", "episode_title")))
    return episodes.groupBy(*keys).agg(F.count("*").alias("episode_count"), listed.alias("e")).select(
        *keys, "episode_count", F.array_join(F.transform("e", lambda e: F.concat(e["episode_num"].cast("string"), F.lit(":"), e["episode_title"])), "|").alias("episodes")
    )


def table_of_contents(chunks: DataFrame) -> DataFrame:
    """Runs of chunks under one heading, in the order of episode and index: collection, episode_num (of the run's start), chunk_index,
    heading, chunk_count, token_count, first_chunk_id, source_type.

    Runs are found within episodes, so no task holds a whole collection; runs that go on over the ends of episodes are joined from the episodes' summaries.
    """
    ep = ["collection", "episode_num"]
    w = Window.partitionBy(*ep).orderBy("chunk_index", "chunk_key")
    c = chunks.select("chunk_key", *ep, "chunk_index", "id", "source_type", heading_of().alias("heading"), T.token_estimate(F.col("text")).alias("tokens"))
    c = c.withColumn("new", (~F.lag("heading").over(w).eqNullSafe(F.col("heading"))).cast("int")).withColumn("run", F.sum("new").over(w))
    first = F.min(F.struct("chunk_index", "chunk_key", "id", "source_type")).alias("first")
    runs = c.groupBy(*ep, "run").agg(F.first("heading").alias("heading"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), first)
    ends = runs.groupBy(*ep).agg(F.max("run").alias("last_run"), F.min_by("heading", "run").alias("head"), F.max_by("heading", "run").alias("tail"))
    e = Window.partitionBy("collection").orderBy("episode_num")
    ends = ends.withColumn("goes_on", F.coalesce(F.lag("tail").over(e) == F.col("head"), F.lit(False)))
    origin = F.last(F.when((F.col("last_run") > 1) | ~F.col("goes_on"), F.struct("episode_num", "last_run")), ignorenulls=True).over(e.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*ep, "goes_on", origin.alias("origin"))
    joined = (F.col("run") == 1) & F.col("goes_on")
    whole = runs.join(ends, ep).withColumns(
        {"start_ep": F.when(joined, F.col("origin.episode_num")).otherwise(F.col("episode_num")), "start_run": F.when(joined, F.col("origin.last_run")).otherwise(F.col("run"))}
    )
    whole = whole.groupBy("collection", "start_ep", "start_run").agg(
        F.first("heading").alias("heading"), F.sum("chunks").alias("chunk_count"), F.sum("tokens").alias("token_count"), F.min_by("first", "episode_num").alias("f")
    )
    return whole.select("collection", F.col("start_ep").alias("episode_num"), "f.chunk_index", "heading", "chunk_count", "token_count", F.col("f.id").alias("first_chunk_id"), "f.source_type")


def new_chunks(incoming: DataFrame, stored: DataFrame, scope: str = "collection") -> DataFrame:
    """The incoming chunks whose text isn't in the store: in another episode of the collection, or (scope "global") anywhere.

    Both sides need collection, episode_num and text. Copies within the batch all stay. Null texts are never known.
    """
    mine = incoming.withColumn("__hash", T.content_hash(F.col("text")))
    held = stored.where(F.col("text").isNotNull()).select(T.content_hash(F.col("text")).alias("__h"), F.col("collection").alias("__c"), F.col("episode_num").alias("__e"))
    if scope == "global":
        return mine.join(held.select("__h").distinct(), F.col("__hash") == F.col("__h"), "left_anti").drop("__hash")
    on = [F.col("__hash") == F.col("__h"), F.col("collection") == F.col("__c"), F.col("episode_num") != F.col("__e")]
    return mine.join(held.distinct(), on, "left_anti").drop("__hash")


def without(chunks: DataFrame, collection: str, episode: int | None = None) -> DataFrame:
    """The chunks that a delete of a collection, or of one of its episodes, leaves."""
    gone = F.col("collection") == collection
    return chunks.where(~(gone if episode is None else gone & (F.col("episode_num") == episode)))


#: Parts of a collection in the store: an episode belongs to one, so an ingest rewrites only that.
EPISODE_BUCKETS = 64


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("episode_bucket", F.pmod("episode_num", F.lit(EPISODE_BUCKETS)))


def write_store(chunks: DataFrame, path: str) -> None:
    """A new store: Parquet by collection and bucket of episodes."""
    _bucketed(chunks).repartition("collection", "episode_bucket").write.partitionBy("collection", "episode_bucket").mode("errorifexists").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's chunks; filters on collection read only its folders."""
    return spark.read.parquet(path).drop("episode_bucket")


def _rewrite(rows: DataFrame, path: str) -> None:
    """Write the parts of the store that ``rows`` are in, whole, in place of what they were; ``rows`` are written out first, as they were read from there."""
    held = materialize(_bucketed(rows), "store-parts")
    held.write.partitionBy("collection", "episode_bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _touched(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored chunks of the parts that the keys (collection, episode_num) are in. An ingest's keys are few, so Spark prunes the folders by them."""
    parts = _bucketed(keys).select("collection", "episode_bucket").distinct()
    return stored.join(F.broadcast(parts) if keys.count() <= BROADCAST_KEYS else parts, ["collection", "episode_bucket"], "left_semi")


#: Keys of an ingest up to which they're broadcast.
BROADCAST_KEYS = 100_000


def replace_episodes(path: str, incoming: DataFrame) -> None:
    """Put the incoming chunks in place of their episodes (all of an episode's chunks come at once). Only the parts of the store that hold these episodes are read and rewritten; others aren't touched.

    A store that isn't there is made. Columns that the incoming chunks lack are null."""
    spark = incoming.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        write_store(incoming, path)
        return
    keys = incoming.select("collection", "episode_num").distinct()
    kept = _touched(stored, keys).join(keys, ["collection", "episode_num"], "left_anti").drop("episode_bucket")
    _rewrite(kept.unionByName(incoming, allowMissingColumns=True).select(*kept.columns), path)


def delete_from_store(spark: SparkSession, path: str, collection: str, episode: int | None = None) -> None:
    """Delete a collection, or one of its episodes: folders that are left empty are removed, the part of an episode that shares its folder is rewritten."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    escaped = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(collection)
    folder = f"{path.rstrip('/')}/collection={escaped}"
    if episode is None:
        files.delete(where(folder), True)
        return
    own = spark.read.parquet(path).where((F.col("collection") == collection) & (F.col("episode_bucket") == episode % EPISODE_BUCKETS)).drop("episode_bucket")
    left = own.where(F.col("episode_num") != episode)
    if left.isEmpty():
        files.delete(where(f"{folder}/episode_bucket={episode % EPISODE_BUCKETS}"), True)
    else:
        _rewrite(left, path)


def ingest(path: str, incoming: DataFrame, scope: str = "collection") -> DataFrame:
    """Add an ingest's chunks: those whose text is new (see ``new_chunks``) replace their episodes; gives them. An episode of which nothing is new is emptied, so nothing old stays."""
    spark = incoming.sparkSession
    try:
        stored = read_store(spark, path)
    except AnalysisException:
        stored = incoming.limit(0)
    added = materialize(new_chunks(incoming, stored, scope), "store-incoming")
    empty = incoming.select("collection", "episode_num").distinct().join(added, ["collection", "episode_num"], "left_anti")
    for r in empty.toLocalIterator():  # a row an episode of the ingest
        delete_from_store(spark, path, r.collection, r.episode_num)
    replace_episodes(path, added)
    return added


def compact(spark: SparkSession, path: str, collection: str) -> None:
    """Rewrite a collection's folders with one file each."""
    own = spark.read.parquet(path).where(F.col("collection") == collection).drop("episode_bucket")
    held = materialize(_bucketed(own), "store-parts").repartition("collection", "episode_bucket")
    held.write.partitionBy("collection", "episode_bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def source_location() -> Column:
    """Where in its source a chunk stands, as text: a time, lines, or a page, heading and chapter."""
    t = F.col("source_type")
    media = F.concat_ws("|", "time_label", F.col("start_sec").cast("string"), F.col("end_sec").cast("string"))
    code = F.concat_ws("|", "file_path", F.col("line_start").cast("string"), F.col("line_end").cast("string"))
    return F.when(t.isin("video", "audio"), media).when(t == "code", code).otherwise(F.concat_ws("|", F.col("page_num").cast("string"), "section_heading", "chapter"))


def compact_results(rows: DataFrame, score: Column) -> DataFrame:
    """Results without their texts: id, score, tokens, the compact columns and the location."""
    return rows.select(F.col("id").alias("chunk_id"), score.alias("score"), T.token_estimate(F.col("text")).alias("token_count"), *COMPACT, source_location().alias("location"))


def as_of_chapter(chunks: DataFrame, keys: list[str], at: str, chapter: str, key: str) -> DataFrame:
    """key and the title of the last chapter that began at or before each chunk; chapters are the rows with a title.

    One window over each episode, no join; a title that begins with "<Untitled" assigns nothing."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    began = F.when(F.col(chapter) != "", F.struct(F.col(at).alias("a"), F.col(key).alias("k"), F.col(chapter).alias("title")))
    last = F.max(began).over(w)["title"]
    return chunks.select(key, F.when(~last.startswith("<Untitled"), last).alias("chapter_title"))
