"""The test tables as the engine's tables, for the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import table

STRINGS = "id text collection collection_display topic subtopic episode_title url source_type time_label section_heading chapter title summary keywords entities questions semantic_key concept_tags language file_path content_hash channel upload_date description".split()
NUMBERS = "episode_num start_sec end_sec page_num line_start line_end chunk_index".split()

#: Chunks without nulls, as the engine keeps them: empty texts, zeros, and the middle importance.
CHUNKS = "(SELECT chunk_key, " + ", ".join([*(f"coalesce({c}, '') AS {c}" for c in STRINGS), *(f"coalesce({c}, 0) AS {c}" for c in NUMBERS), "coalesce(importance, 3) AS importance"]) + " FROM chunks)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "chunks")
    return df.select(
        "chunk_key",
        *(F.coalesce(c, F.lit("")).alias(c) for c in STRINGS),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in NUMBERS),
        F.coalesce("importance", F.lit(3)).alias("importance"),
    )
