"""The graph of entities that share chunks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.session import materialize

MIN_PAIR = 3
#: Entities of a chunk that are paired in one place; more are cut into blocks, and pairs of blocks are spread.
BLOCK = 256
#: Least gain of modularity that counts, and rounds without a gain after which a level ends.
GAIN, STALLED = 1e-9, 2


def incidence(found: DataFrame, clustered: DataFrame) -> DataFrame:
    """chunk_key and entity, each pair once, of chunks with two entities or more."""
    pairs = found.select("chunk_key", "name").distinct().join(clustered, "name").select("chunk_key", F.col("canonical").alias("entity")).distinct()
    several = pairs.groupBy("chunk_key").agg(F.count("*").alias("k")).where("k > 1").select("chunk_key")
    return pairs.join(several, "chunk_key", "left_semi")


def npmi(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information; 0 without data, 1 for a pair that is in every chunk."""
    p = both / n
    score = F.log(p / ((a / n) * (b / n))) / -F.log(p)
    return F.when((both == 0) | (n == 0), 0.0).when(both == n, 1.0).otherwise(score)


def vertices(pairs: DataFrame) -> DataFrame:
    """entity and docfreq."""
    return pairs.groupBy("entity").agg(F.count("*").alias("docfreq"))


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """a < b and cooccur. Entities are paired within the chunk, a chunk of very many in blocks; counts are pre-aggregated before the shuffle."""
    sets = pairs.groupBy("chunk_key").agg(F.array_sort(F.collect_list("entity")).alias("e"))
    cuts = F.ceil(F.size("e") / BLOCK).cast("int")
    block = lambda k: F.slice("e", k * BLOCK + 1, BLOCK)
    small = sets.where(F.size("e") <= BLOCK).select("e", F.posexplode("e").alias("i", "a"))
    small = small.select("a", F.explode(F.slice("e", F.col("i") + 2, F.greatest(F.size("e"), F.lit(1)))).alias("b"))
    large = sets.where(F.size("e") > BLOCK).select("e", cuts.alias("cuts"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("p"))
    large = large.select("e", "p", F.explode(F.sequence(F.col("p"), F.col("cuts") - 1)).alias("q")).select(block(F.col("p")).alias("x"), block(F.col("q")).alias("y")).repartition("x", "y")
    large = large.select("y", F.explode("x").alias("a")).select("a", F.explode("y").alias("b")).where("a < b")
    return small.unionByName(large).groupBy("a", "b").agg(F.count("*").alias("cooccur"))


def edges(pairs: DataFrame, least: int = MIN_PAIR) -> DataFrame:
    """a < b, cooccur and npmi of pairs that share ``least`` chunks and have a positive npmi."""
    v = vertices(pairs)
    n = pairs.agg(F.countDistinct("chunk_key").alias("n"))
    c = cooccurrence(pairs).where(F.col("cooccur") >= least)
    c = c.join(v.select(F.col("entity").alias("a"), F.col("docfreq").alias("da")), "a").join(v.select(F.col("entity").alias("b"), F.col("docfreq").alias("db")), "b")
    c = c.join(F.broadcast(n))  # one row
    c = c.withColumn("npmi", F.round(npmi(F.col("cooccur"), F.col("da"), F.col("db"), F.col("n")), 4))
    return c.where("npmi > 0").select("a", "b", "cooccur", "npmi")


def both_ways(e: DataFrame) -> DataFrame:
    """entity, neighbor and npmi in both directions."""
    return e.select(F.col("a").alias("entity"), F.col("b").alias("neighbor"), "npmi").unionByName(e.select(F.col("b").alias("entity"), F.col("a").alias("neighbor"), "npmi"))


def modularity(around: DataFrame, labels: DataFrame) -> float:
    """Of a weighted graph (entity, neighbor, w in both directions, loops twice) under labels (entity, community): the weight inside communities less what chance puts there."""
    inside = around.join(labels, "entity").join(labels.select(F.col("entity").alias("neighbor"), F.col("community").alias("other")), "neighbor")
    per = inside.groupBy("community").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("community") == F.col("other"), F.col("w")).otherwise(0.0)).alias("inside"))
    r = per.agg(F.sum("total"), F.sum("inside"), F.sum(F.col("total") * F.col("total"))).first()
    return (r[1] / r[0] - r[2] / (r[0] * r[0])) if r[0] else 0.0


def _moved(around: DataFrame, labels: DataFrame, degree: DataFrame, total: float, turn: int) -> DataFrame:
    """Labels after half of the entities (by hash and turn) went to the neighbouring community of most gain, ties to the smallest."""
    own = labels.join(degree, "entity")
    sizes = own.groupBy("community").agg(F.sum("k").alias("size"))
    links = around.where("entity <> neighbor").join(labels.withColumnRenamed("entity", "neighbor"), "neighbor").select("entity", "community", "w").unionByName(labels.select("entity", "community", F.lit(0.0).alias("w")))
    links = links.groupBy("entity", "community").agg(F.sum("w").alias("w")).join(own.withColumnRenamed("community", "own"), "entity").join(sizes, "community")
    rest = F.col("size") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
    links = links.withColumn("gain", F.round(F.col("w") - F.col("k") * rest / total, 9))
    best = links.groupBy("entity", "own").agg(F.min_by("community", F.struct(-F.col("gain"), F.col("community"))).alias("new"), F.max("gain").alias("most"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("stay"))
    goes = (F.pmod(F.xxhash64("entity", F.lit(turn // 2)), F.lit(2)) == turn % 2) & (F.col("most") > F.col("stay"))
    return best.select("entity", F.when(goes, F.col("new")).otherwise(F.col("own")).alias("community"))


def _level(around: DataFrame) -> tuple[DataFrame, float, bool]:
    """(labels, modularity, whether anything moved) of one level: moves go on as long as modularity grows, so they end by themselves."""
    degree = materialize(around.groupBy("entity").agg(F.sum("w").alias("k")), "graph-degree")
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    labels = degree.select("entity", F.col("entity").alias("community"))
    best, moved, stalled, turn = modularity(around, labels), False, 0, 0
    while stalled < STALLED:
        new = materialize(_moved(around, labels, degree, total, turn), "graph-labels")
        score = modularity(around, new)
        if score > best + GAIN:
            labels, best, moved, stalled = new, score, True, 0
        else:
            stalled += 1
        turn += 1
    return labels, best, moved


def communities(v: DataFrame, e: DataFrame) -> DataFrame:
    """entity and community (its smallest entity): modularity is raised by moving entities between neighbouring communities, then whole communities, level by level, until no move raises it.

    All moves of a round are made in parallel, by half of the entities, and are taken back if modularity doesn't grow. Deterministic; an entity without edges is a community of its own. The graph is never
    collected: a round is a few joins and aggregations, written out.
    """
    around = materialize(both_ways(e).select("entity", "neighbor", F.col("npmi").alias("w")), "graph-edges")
    whole = v.select("entity", F.col("entity").alias("community"))
    while True:
        labels, _, moved = _level(around)
        if not moved:
            break
        whole = whole.join(labels.select(F.col("entity").alias("community"), F.col("community").alias("next")), "community", "left").select("entity", F.coalesce("next", "community").alias("community"))
        whole = materialize(whole, "graph-communities")
        side = lambda c: labels.select(F.col("entity").alias(c), F.col("community").alias(c + "_c"))
        around = around.join(side("entity"), "entity").join(side("neighbor"), "neighbor").groupBy(F.col("entity_c").alias("entity"), F.col("neighbor_c").alias("neighbor")).agg(F.sum("w").alias("w"))
        around = materialize(around, "graph-edges")
    names = whole.groupBy("community").agg(F.min("entity").alias("name"))
    return whole.join(names, "community").select("entity", F.col("name").alias("community"))


def members(labels: DataFrame, v: DataFrame, asked: DataFrame, most: int | None = None) -> DataFrame:
    """entity, member and docfreq of the communities of the asked entities (column entity), without themselves, the most frequent first; ``most`` of each (rank comes with it) or all."""
    own = asked.select("entity").distinct().join(labels, "entity")
    others = labels.join(v, "entity").select("community", F.col("entity").alias("member"), "docfreq")
    if most is not None:  # the first of a community and one more hold the first of each of its entities
        w = Window.partitionBy("community").orderBy(F.col("docfreq").desc(), "member")
        others = others.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most + 1).drop("__n")
    found = own.join(others, "community").where("entity <> member")
    w = Window.partitionBy("entity").orderBy(F.col("docfreq").desc(), "member")
    found = found.select("entity", "member", "docfreq", F.row_number().over(w).alias("rank"))
    return found if most is None else found.where(F.col("rank") <= most)


def neighbors(e: DataFrame, asked: DataFrame, kinds: DataFrame, labels: DataFrame | None = None, most: int = 10) -> DataFrame:
    """entity, neighbor, npmi, cooccur, type and rank (and community with ``labels``) of the strongest neighbours of the asked entities."""
    two = e.select(F.col("a").alias("entity"), F.col("b").alias("neighbor"), "npmi", "cooccur").unionByName(e.select(F.col("b").alias("entity"), F.col("a").alias("neighbor"), "npmi", "cooccur"))
    w = Window.partitionBy("entity").orderBy(F.col("npmi").desc(), "neighbor")
    found = two.join(asked.select("entity").distinct(), "entity", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    found = found.join(kinds.select(F.col("canonical").alias("neighbor"), "type"), "neighbor", "left")
    if labels is not None:
        found = found.join(labels.select(F.col("entity").alias("neighbor"), "community"), "neighbor", "left")
    return found.select("entity", "neighbor", "npmi", "cooccur", "type", "rank", *([] if labels is None else ["community"]))


def save_graph(v: DataFrame, e: DataFrame, labels: DataFrame, folder: str) -> None:
    """Write the graph: nodes with their communities, and edges, each a table that is replaced whole."""
    v.join(labels, "entity", "left").write.mode("overwrite").parquet(f"{folder}/nodes")
    e.write.mode("overwrite").parquet(f"{folder}/edges")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) as written; None if there is no whole graph."""
    try:
        return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
    except AnalysisException:
        return None


def bridges(v: DataFrame, e: DataFrame, labels: DataFrame) -> DataFrame:
    """entity, communities_bridged and degree of entities with neighbours in at least two foreign communities."""
    around = both_ways(e).join(labels.select(F.col("entity").alias("neighbor"), F.col("community").alias("other")), "neighbor").join(labels, "entity")
    foreign = F.when(F.col("other") != F.col("community"), F.col("other"))
    found = around.groupBy("entity").agg(F.countDistinct(foreign).alias("foreign"), F.count("*").alias("degree")).where("foreign >= 2")
    return found.select("entity", (F.col("foreign") + 1).alias("communities_bridged"), "degree")
