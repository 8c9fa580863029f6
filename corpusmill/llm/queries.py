"""The queries of this subpackage, run over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import conversations, cooccurrence, leaks, names_json, neardup, spam, splitting, sql, tokens, variants
from corpusmill.session import table

#: Light revision: distinct runs of three words, at least half of them shared, texts of 20 words or more.
REVISED = neardup.Rule(n=3, threshold=0.5, min_words=20)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.pairs(table(spark, sf_dir, "chunks"), "text", "chunk_key", REVISED)
    return found.select(F.col("key_a").alias("chunk_a"), F.col("key_b").alias("chunk_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles at 0.8: one row per chunk with its class and number of links."""
    return neardup.classes(table(spark, sf_dir, "chunks"), "text", "chunk_key").withColumnRenamed("key", "chunk_key")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.whole_conversations(table(spark, sf_dir, "messages"), table(spark, sf_dir, "chat_sessions"))
    return found.select("session_id", "turn_no", "message_id")


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conversations with who said what."""
    found = conversations.whole_conversations(table(spark, sf_dir, "messages"), table(spark, sf_dir, "chat_sessions"), "content")
    return found.select("session_id", "turn_no", "role", "content")


def _chunk_sets(field: str, value: str | None) -> set[str]:
    """Names of entities, lower-cased, or concept tags."""
    if field == "entities":
        return {name.lower() for name, _ in names_json.named(value)}
    return {t for t in (x.strip().lower() for x in (value or "").split(",")) if t}


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.baskets(table(spark, sf_dir, "chunks"), ["entities", "concept_tags"], _chunk_sets)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that the null and its false-discovery rate keep, at the rate that loses none of the stated cases; of them the cases, by exact counts and lift."""
    return cooccurrence.cases(_sets(spark, sf_dir), min_shared=4, min_lift=8).select("field", "item_a", "item_b")


def p3_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that hold at a false-discovery rate of one in a hundred under the fitted null."""
    sets = _sets(spark, sf_dir)
    found = cooccurrence.with_false_discovery(cooccurrence.surprising_pairs(sets, min_shared=1), sets)
    return found.where("q <= 0.01")


def _oversized(spark: SparkSession, sf_dir: str, place) -> DataFrame:
    sections = splitting.sections(table(spark, sf_dir, "extracted_documents"), "extract_id", "sections")
    results = table(spark, sf_dir, "search_results")
    texts = sections.select(F.lit("section").alias("origin"), F.col("extract_id").alias("item_id"), F.col("section_no").cast("int").alias("section_no"), "text").unionByName(
        results.select(F.lit("result").alias("origin"), F.col("result_id").alias("item_id"), F.lit(0).alias("section_no"), "text")
    )
    return splitting.pieces(texts, ["origin", "item_id", "section_no"], "text", place=place)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oversized(spark, sf_dir, splitting.longest)


def p4_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts in pieces of nearly equal length."""
    return _oversized(spark, sf_dir, splitting.balanced)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.pairs(table(spark, sf_dir, "chunks"), "entities")


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per name with the entity it stands for."""
    return variants.clusters(table(spark, sf_dir, "chunks"), "entities")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaked passages cut out."""
    return leaks.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.flagged(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p8_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each strongest non-prose shape leads, and how many of those it makes spam."""
    found = spam.shares(table(spark, sf_dir, "documents"), "doc_id", "text")
    led = found.where(F.size("shapes") > 0).select(F.col("shapes")[0].alias("shape"), (F.col("share") > spam.DOMINANT).cast("long").alias("spam"))
    return led.groupBy("shape").agg(F.count("*").alias("documents"), F.sum("spam").alias("flagged"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
