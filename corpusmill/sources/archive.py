"""The archive of a collection: one folder with its chunks, extracted text and summaries as JSON, replaced whole."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(folder: str, collection: str, parts: dict[str, object]) -> str:
    """Write the parts (file name to JSON value or text) of one collection; an older archive stays until the new one is whole, and comes back if the swap fails."""
    final = os.path.join(folder, collection)
    new, old = (f"{final}.{tag}-{uuid.uuid4().hex}" for tag in ("new", "old"))
    os.makedirs(new)
    try:
        for name, value in parts.items():
            with open(os.path.join(new, name), "w", encoding="utf-8") as f:
                f.write(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
        had = os.path.exists(final)
        if had:
            os.rename(final, old)
        try:
            os.rename(new, final)
        except OSError:
            if had:
                os.rename(old, final)
            raise
        shutil.rmtree(old, ignore_errors=True)
    except BaseException:
        shutil.rmtree(new, ignore_errors=True)
        raise
    return final


def read_chunks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The chunks of all archives under a folder, with their collection; a broken file gives no rows."""
    rows = spark.read.text(f"{folder}/*/chunks.json", wholetext=True).select(F.input_file_name().alias("path"), "value")
    parsed = rows.select(F.regexp_extract("path", "([^/]+)/[^/]*$", 1).alias("collection"), F.from_json("value", f"array<struct<{schema}>>").alias("c"))
    return parsed.select("collection", F.explode("c").alias("c")).select("collection", "c.*")


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """collection, display_name, topic, subtopic, source_type, chunk_count, overview, themes (the first five, by theme or title), tags and key_takeaways of the archives that have a summary; broken files count as missing."""

    def part(name: str, schema: str) -> DataFrame:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
        return files.select(F.regexp_extract("path", "([^/]+)/[^/]*$", 1).alias("collection"), F.from_json("value", schema).alias("j")).where("j IS NOT NULL")

    summary = part("book_summary.json", "overview string, main_themes array<struct<theme:string,title:string>>, tags array<string>, key_takeaways array<string>, _corrupt_record string").where("j._corrupt_record IS NULL").select("collection", "j.overview", "j.main_themes", "j.tags", "j.key_takeaways")
    meta = part("meta.json", "collection_display string, topic string, subtopic string, source_type string, chunk_count int").select("collection", "j.*")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    themes = F.slice(F.transform(F.coalesce("main_themes", F.array().cast("array<struct<theme:string,title:string>>")), lambda t: F.coalesce(t["theme"], t["title"], F.lit(""))), 1, 5)
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return summary.join(meta, "collection", "left").select("collection", F.coalesce("collection_display", "collection").alias("display_name"), blank("topic"), blank("subtopic"), blank("source_type"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), blank("overview"), themes.alias("themes"), none("tags"), none("key_takeaways"))
