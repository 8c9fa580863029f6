"""Entity mentions, their normal forms, clusters of variants, and lookups."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.functions.similarity import similar_pairs
from corpusmill.session import materialize

# Names that are noise, structural labels, roman numerals, leading words, known places, and the coarse class of each type.
STOP_ENTITIES = "king majesty state palace army emperor lord prince minister general master sir strong ford moon earth sun god".split()
STRUCTURAL = r"(?i)^(?:chapter|section|figure|fig\.?|table|appendix|part|volume|page|exhibit)\s+(?:\d[\d.a-z]*|[a-z]|[ivxlc]+)$"
ROMAN = r"^(?:I{1,4}V?|VI{0,4}|IX|XI{0,3}|XI?V|XV?I{0,3})$"
LEADING = r"(?i)^(?:the|a|an|of|in|on|at|to|for|by|with|from|thereupon|introduction)\s+"
PLACES = """france,london,paris,china,rome,spain,england,germany,italy,russia,japan,india,egypt,greece,turkey,persia,austria,prussia,holland,brazil,mexico,canada,australia,ireland,scotland,
venice,milan,naples,amsterdam,berlin,vienna,moscow,beijing,tokyo,new york,los angeles,chicago,boston,philadelphia,athens,carthage,constantinople,babylon,jerusalem,africa,europe,asia,america,arabia""".replace("\n", "").split(",")
COARSE = {"PERSON": "PERSON", "ORG": "ORG", "GPE": "PLACE", "LOC": "PLACE", "FAC": "PLACE", "WORK_OF_ART": "WORK", "LAW": "WORK", "EVENT": "EVENT", "PRODUCT": "PRODUCT", "TECH": "PRODUCT", "CONCEPT": "CONCEPT", "METRIC": "METRIC", "NORP": "GROUP"}
PUNCTUATION = "'\".,;:!?()[]{}"


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition; null stays null."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


def normalize(name: Column) -> Column:
    """A name for comparison: decomposed, one space between words, without a possessive, one leading noise word, and punctuation at the ends. Case stays."""
    s = F.regexp_replace(F.regexp_replace(nfkd(name), r"(?U)\s+", " "), "^ | $", "")
    s = F.regexp_replace(F.regexp_replace(s, "'s$", ""), LEADING, "")
    return F.btrim(F.btrim(F.btrim(s), F.lit(PUNCTUATION)))


def is_noise(name: Column) -> Column:
    """Whether a normalised name is too short, an acronym of up to three letters, structural, a numeral, a stop word, digits and marks, or a long phrase."""
    upper = (F.upper(name) == name) & (F.lower(name) != name)
    spaces = F.length(name) - F.length(F.replace(name, F.lit(" "), F.lit("")))
    return (F.length(name) < 2) | ((F.length(name) <= 3) & upper) | name.rlike(STRUCTURAL) | name.rlike(ROMAN) | F.lower(name).isin(STOP_ENTITIES) | name.rlike(r"^[.\-()\[\]0-9 ]*$") | (spaces > 6)


def corrected_type(name: Column, kind: Column) -> Column:
    """A known place that was taken for a person or an organisation is a place."""
    return F.when(F.lower(name).isin(PLACES) & kind.isin("PERSON", "ORG"), "GPE").otherwise(kind)


def merge_threshold(name: Column) -> Column:
    """The similarity, of 100, that a name of this length needs."""
    many = F.size(F.filter(F.split(name, r"\s+"), lambda w: w != "")) >= 2
    return F.when(many, 90.0).when(F.length(name) <= 5, 100.0).when(F.length(name) <= 8, 95.0).otherwise(93.0)


def coarse(kind: Column) -> Column:
    """The class of a type; types outside the table are classes of their own."""
    table = F.create_map(*(F.lit(x) for kv in COARSE.items() for x in kv))
    return F.coalesce(table[kind], kind)


def compatible(a: Column, b: Column) -> Column:
    """Types that may be one entity's: of one class, or one unknown or empty."""
    loose = lambda k: k.isin("UNKNOWN", "")
    return (coarse(a) == coarse(b)) | loose(a) | loose(b)


def mentions(chunks: DataFrame, fold: bool = False) -> DataFrame:
    """chunk_key, place, source, raw, name (normalised) and type of every named element of ``entities`` that isn't noise.

    Elements that aren't objects with a name are skipped, and so are texts that aren't JSON arrays. A missing type is UNKNOWN. ``fold`` drops accents from the names.
    """
    e = chunks.select("chunk_key", F.col("collection").alias("source"), F.posexplode(F.from_json("entities", "array<string>")).alias("place", "e"))
    e = e.select("chunk_key", "place", "source", F.get_json_object("e", "$.name").alias("raw"), F.coalesce(F.get_json_object("e", "$.type"), F.lit("UNKNOWN")).alias("type")).where("raw IS NOT NULL")
    name = normalize(F.col("raw"))
    e = e.withColumn("name", F.regexp_replace(name, r"\p{Mn}", "") if fold else name)
    return e.where(~is_noise(F.col("name"))).withColumn("type", corrected_type(F.col("name"), F.col("type")))


def names(found: DataFrame) -> DataFrame:
    """name, mentions, sources, first_key (chunk of the first mention) and type (that of most mentions, ties by text) of every normalised name."""
    votes = found.groupBy("name", "type").agg(F.count("*").alias("n"), F.min("chunk_key").alias("first_key"))
    sources = found.select("name", "source").distinct().groupBy("name").agg(F.count("*").alias("sources"))
    out = votes.groupBy("name").agg(F.sum("n").alias("mentions"), F.min("first_key").alias("first_key"), F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"))
    return out.join(sources, "name")


def variant_pairs(listed: DataFrame) -> DataFrame:
    """a < b and score of names that are similar enough for both their lengths and of compatible types. Similarity ignores case."""
    low = listed.select(F.lower("name").alias("low"), "name", "type", merge_threshold(F.col("name")).alias("needs"))
    near = similar_pairs(low, "low", 0.9)
    same = low.groupBy("low").agg(F.count("*").alias("k")).where("k > 1").select(F.col("low").alias("a"), F.col("low").alias("b"), F.lit(100.0).alias("score"))
    found = near.unionByName(same)
    l, r = (low.select(F.col("low").alias(s), F.col("name").alias(s + "_name"), F.col("type").alias(s + "_type"), F.col("needs").alias(s + "_needs")) for s in "ab")  # noqa: E741
    both = found.join(l, "a").join(r, "b").where((F.col("a_name") != F.col("b_name")) & (F.round("score", 6) >= F.greatest("a_needs", "b_needs")) & compatible(F.col("a_type"), F.col("b_type")))
    return both.select(F.least("a_name", "b_name").alias("a"), F.greatest("a_name", "b_name").alias("b"), F.round("score", 6).alias("score")).distinct()


def clusters(listed: DataFrame) -> DataFrame:
    """name and canonical: each name joins the cluster of its most similar name among those of more mentions (ties by first chunk, then text), else founds its own.

    A name's choice depends on its pairs alone, so choices are made in parallel and followed to their
    roots by pointer jumping; every round halves the chains and is written out.
    """
    order = lambda p: F.struct(-F.col(p + "mentions"), F.col(p + "first_key"), F.col(p + "name"))
    pairs = variant_pairs(listed)
    both = pairs.select(F.col("a").alias("x_name"), F.col("b").alias("y_name"), "score").unionByName(pairs.select(F.col("b").alias("x_name"), F.col("a").alias("y_name"), "score"))
    side = lambda p: listed.select(*(F.col(c).alias(p + c) for c in ("name", "mentions", "first_key")))
    up = both.join(side("x_"), "x_name").join(side("y_"), "y_name").where(order("y_") < order("x_"))
    parent = up.groupBy("x_name").agg(F.min_by("y_name", F.struct(-F.col("score"), order("y_"))).alias("parent"))
    root = listed.select("name").join(parent, F.col("name") == F.col("x_name"), "left").select("name", F.coalesce("parent", "name").alias("root"))
    root = materialize(root, "entity-parents")
    while True:
        onward = root.join(root.select(F.col("name").alias("root"), F.col("root").alias("next")), "root")
        root = materialize(onward.select("name", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "entity-roots")
        if root.where("moved").isEmpty():
            return root.select("name", F.col("root").alias("canonical"))
        root = root.drop("moved")


def summaries(found: DataFrame, clustered: DataFrame) -> DataFrame:
    """canonical, type (majority of mentions), variants, mentions and sources of every cluster."""
    m = found.join(clustered, "name")
    votes = m.groupBy("canonical", "type").agg(F.count("*").alias("n"))
    kinds = votes.groupBy("canonical").agg(F.sum("n").alias("mentions"), F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"))
    sources = m.select("canonical", "source").distinct().groupBy("canonical").agg(F.count("*").alias("sources"))
    variants = clustered.groupBy("canonical").agg(F.count("*").alias("variants"))
    return kinds.join(sources, "canonical").join(variants, "canonical")


def resolve(asked: DataFrame, name: str, clustered: DataFrame, fuzzy: bool = True, fold: bool = False, kinds: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """name and canonical (null if unknown) of every distinct name asked for.

    A name is normalised as mentions are (``fold`` drops accents, too) and taken for the variant that equals it whatever the case; else, if ``fuzzy``, for the most similar variant that is similar enough for the lengths of both.
    With ``kinds`` (canonical, type) and the column ``kind`` of the names' types, only entities of a compatible type come into question for the latter.
    """
    low = F.lower(normalize(F.col(name)))
    low = F.regexp_replace(low, r"\p{Mn}", "") if fold else low
    own = F.lit("") if kind is None else F.coalesce(F.col(kind), F.lit(""))
    wanted = asked.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), low.alias("low"), own.alias("kind")).distinct()
    variant = clustered.groupBy(F.lower("name").alias("low")).agg(F.max("canonical").alias("canonical"))
    exact = wanted.join(variant, "low", "left")
    if not fuzzy:
        return exact.select("name", "canonical")
    exact = materialize(exact, "entity-asked")
    lost = exact.where("canonical IS NULL").select("name", "low", "kind")
    near = similar_pairs(lost.select("low").distinct(), "low", 0.9, variant.select("low"))
    best = near.join(lost.withColumnRenamed("low", "a"), "a").join(variant.select(F.col("low").alias("b"), F.col("canonical").alias("c")), "b")
    best = best.where(F.round("score", 6) >= F.greatest(merge_threshold(F.col("a")), merge_threshold(F.col("b"))))
    if kinds is not None:
        best = best.join(kinds.select(F.col("canonical").alias("c"), "type"), "c").where((F.col("kind") == "") | compatible(F.col("kind"), F.col("type")))
    best = best.groupBy("name", "kind").agg(F.min_by("c", F.struct(-F.round("score", 6), F.col("b"))).alias("near"))
    return exact.join(best, ["name", "kind"], "left").select("name", F.coalesce("canonical", "near").alias("canonical"))


def labels_of(found: DataFrame, clustered: DataFrame) -> DataFrame:
    """chunk_key and entities (array of canonical names) of every chunk that mentions one."""
    return found.select("chunk_key", "name").distinct().join(clustered, "name").groupBy("chunk_key").agg(F.array_sort(F.collect_set("canonical")).alias("entities"))


def save_index(found: DataFrame, clustered: DataFrame, folder: str) -> None:
    """Write the entity index: its summaries and its variants, each a table that is replaced whole."""
    summaries(found, clustered).write.mode("overwrite").parquet(f"{folder}/entities")
    clustered.select("name", "canonical").write.mode("overwrite").parquet(f"{folder}/variants")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(summaries, variants) as written; None if there is no whole index."""
    try:
        return spark.read.parquet(f"{folder}/entities"), spark.read.parquet(f"{folder}/variants")
    except AnalysisException:
        return None
