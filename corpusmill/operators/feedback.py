"""Sessions, messages, ratings and usage, derived from append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Minutes for which what a session fetched counts as seen.
TTL_MINUTES = 30


def id_list(c: Column) -> Column:
    """The ids of a JSON array; none if it's null or broken."""
    return F.array_distinct(F.filter(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull()))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def chunk_ratings(log: DataFrame) -> DataFrame:
    """chunk_id, fetches, ignores, explicit_up, explicit_down, from the log of interactions.

    An interaction counts once for each chunk: as fetched; as ignored if it was shown but not fetched while others were; as rated up (rating above 0) or down.
    Rows that are repeated whole count once. All are sums over exploded ids, so a hot chunk or session is pre-aggregated before the shuffle.
    """
    x = log.select("id", "session_id", "occurred_at", "action", "chunk_ids_shown", "chunk_ids_fetched", "chunk_ids_rated", "rating").distinct()
    x = x.select(id_list(F.col("chunk_ids_shown")).alias("s"), id_list(F.col("chunk_ids_fetched")).alias("f"), id_list(F.col("chunk_ids_rated")).alias("g"), "rating")
    mark = lambda ids, **set_: F.transform(ids, lambda i: F.struct(i.alias("chunk_id"), *(F.coalesce(set_[k], F.lit(0)).cast("long").alias(k) if k in set_ else F.lit(0).cast("long").alias(k) for k in KINDS)))
    none = F.array().cast("array<struct<chunk_id:string,fetches:bigint,ignores:bigint,explicit_up:bigint,explicit_down:bigint>>")
    events = F.concat(
        mark(F.col("f"), fetches=F.lit(1)),
        F.when(F.size("f") > 0, mark(F.array_except("s", "f"), ignores=F.lit(1))).otherwise(none),
        F.when(F.col("rating").isNotNull(), mark(F.col("g"), explicit_up=(F.col("rating") > 0).cast("int"), explicit_down=(F.col("rating") <= 0).cast("int"))).otherwise(none),
    )
    return x.select(F.explode(events).alias("e")).select("e.*").groupBy("chunk_id").agg(*(F.sum(k).alias(k) for k in KINDS))


KINDS = ["fetches", "ignores", "explicit_up", "explicit_down"]


def net_score() -> Column:
    return (F.col("fetches") + 3 * F.col("explicit_up")) - (F.col("ignores") + 3 * F.col("explicit_down"))


def fetched(log: DataFrame, asked: DataFrame, key: str, minutes: int = TTL_MINUTES) -> DataFrame:
    """key and chunk_id of what each asking session (key, session_id, now) had fetched within the minutes before now; an expired fetch counts no more, and a fetch at the limit has expired."""
    seen = log.where("action = 'get_context'").select("session_id", "occurred_at", F.explode(id_list(F.col("chunk_ids_fetched"))).alias("chunk_id"))
    recent = (F.col("occurred_at") <= F.col("now")) & (F.col("occurred_at") > F.col("now") - F.expr(f"INTERVAL {minutes} MINUTE"))
    return asked.join(seen, "session_id").where(recent).select(key, "chunk_id").distinct()


def list_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Every session in its latest state, with the number of its distinct messages."""
    now = latest(sessions, ["id"], ["updated_at", "created_at", "title"])
    counts = messages.select("id", F.col("session_id").alias("sid")).distinct().groupBy("sid").agg(F.count("*").alias("messages"))
    return now.join(counts, F.col("id") == F.col("sid"), "left").select("id", "title", "updated_at", F.coalesce("messages", F.lit(0)).alias("messages"))


def top_queries(log: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent queries of searches: query and searches."""
    found = log.where(F.col("action").isin("search", "search_deep") & F.col("query").isNotNull()).select("id", "session_id", "occurred_at", "query").distinct()
    return found.groupBy("query").agg(F.count("*").alias("searches")).orderBy(F.col("searches").desc(), "query").limit(most)
