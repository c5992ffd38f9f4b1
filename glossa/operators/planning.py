"""One canonical rendering per term, and what systems are told about terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossa.functions.similarity import inner, with_direction
from glossa.functions.text import norm_key, strip
from glossa.operators.grounding import sent_if_small
from glossa.operators.ontology import NEIGHBOURS, by_name, neighbours

#: From a text column to its vectors: a plug-in's Pandas UDF, or an expression.
Embedder = Callable[[Column], Column]
ALPHA, BETA, GAMMA = 0.5, 0.3, 0.2


def plan_locks(candidates: DataFrame, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> DataFrame:
    """(term, en, score) from (term, en, ord, context_sim, neighbour_sim, level, own_level): the highest weighted score, the first of equal ones.

    Similarities are means over the term's segments and the concept's neighbours; unknown levels cost nothing.
    """
    distance = F.when(F.col("level").isNull(), 0).otherwise(F.abs(F.col("level") - F.coalesce("own_level", F.lit(0))))
    score = alpha * F.coalesce("context_sim", F.lit(0.0)) + beta * F.coalesce("neighbour_sim", F.lit(0.0)) - gamma * distance
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "ord"))
    return candidates.withColumn("score", score).withColumn("place", place).where("place = 1").select("term", "en", "score")


def mean_direction(rows: DataFrame, by: str, direction: str, size: int) -> DataFrame:
    """(by, n, mean): the mean of unit vectors of ``size`` numbers, place by place; a null vector counts as zero.

    The mean cosine of a vector with all of them is its own direction times this mean, so what meets the vector is one row
    a group and not one a member. The sums combine before the shuffle.
    """
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col(direction)[i]), F.lit(0.0)).alias(f"_s{i}") for i in range(size)])
    return sums.select(by, "n", F.array(*[F.col(f"_s{i}") / F.col("n") for i in range(size)]).alias("mean"))


def segment_locks(segments: DataFrame, index: DataFrame, concepts: DataFrame, edges: DataFrame, embed: Embedder, size: int, cap: int = NEIGHBOURS, wide: bool = True) -> DataFrame:
    """(term, en, score): the English rendering that each term of ``segments`` (id, text, terms) is locked to.

    A term is grounded by its key in ``index``; ambiguous and unknown ones get no lock. Candidates are the concept's name and up to
    ``cap`` names around it, in this order. A candidate's context is its mean cosine with the texts in which the term
    stands (each place counts), its neighbourhood the mean cosine with the names around the concept; see :func:`plan_locks`.
    Blank terms are left out; texts and names without a direction (zero vectors) have a cosine of 0 with everything.
    Texts are embedded once each and names once each. Similarities are rounded to nine places, so that equal candidates tie.
    """
    own = with_direction(segments, embed(F.col("text")), "direction").select("direction", F.explode("terms").alias("word"))
    own = own.select(strip(F.col("word")).alias("term"), "direction").where("term <> ''")
    # Most distinct words are of no concept; they are left out before directions are summed.
    named = segments.select(F.explode("terms").alias("word")).distinct().select(strip(F.col("word")).alias("term")).distinct()
    known_keys = index.where("not is_ambiguous").select("key")
    named = sent_if_small(named.where("term <> ''").withColumn("key", norm_key(F.col("term"), wide=wide)).join(known_keys, "key", "left_semi").select("term"))
    terms = mean_direction(own.join(named, "term", "left_semi"), "term", "direction", size).persist()
    known = index.where("not is_ambiguous").select("key", F.col("concept.id").alias("id"), F.col("concept.name").alias("name"), F.col("concept.level").alias("own_level"))
    ground = terms.withColumn("key", norm_key(F.col("term"), wide=wide)).join(known, "key").select("term", "id", "name", "own_level", F.col("mean").alias("context"))
    around = neighbours(edges, concepts, ground, cap).persist()  # listed, embedded and averaged
    listed = ground.join(around, "id", "left").withColumn("names", F.concat(F.array("name"), F.coalesce("names", F.array().cast("array<string>"))))
    listed = listed.select("term", "id", "own_level", "context", F.posexplode("names").alias("ord", "en")).where("en is not null")
    names = with_direction(listed.select("en").distinct(), embed(F.col("en")), "direction")
    near = mean_direction(around.select("id", F.explode("names").alias("en")).join(names, "en", "left"), "id", "direction", size).select("id", F.col("mean").alias("near"))
    levels = by_name(concepts).select("key", F.col("concept.level").alias("level"))
    rows = listed.join(names, "en").join(near, "id", "left").join(levels, F.lower(strip(F.col("en"))) == F.col("key"), "left")
    similarity = lambda c: F.round(F.coalesce(inner(F.col("direction"), F.col(c)), F.lit(0.0)), 9)
    return plan_locks(rows.select("term", "en", "ord", similarity("context").alias("context_sim"), similarity("near").alias("neighbour_sim"), "level", "own_level"))


def phrases(terms: DataFrame, glossary: DataFrame, normalise_keys: bool = False) -> DataFrame:
    """(id, phrases): distinct English phrases of each segment's terms (id, pos, word), in the order of the terms.

    As shipped, glossary keys are taken as they are, so keys with capitals never match; ``normalise_keys`` mends that.
    """
    key = norm_key(F.col("fr")) if normalise_keys else F.col("fr")
    g = glossary.groupBy(key.alias("key")).agg(F.max_by("en", "pos").alias("en"))
    rows = terms.withColumn("key", norm_key(F.col("word"))).join(g, "key")
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "en"))), lambda x: x["en"])
    return rows.groupBy("id").agg(F.array_distinct(own).alias("phrases"))


def rerank(candidates: DataFrame) -> DataFrame:
    """(id, ord, hyp, score): of (id, ord, hyp, hits, branch) the hypothesis with most contained names, half a point for its branch; the first of equal ones."""
    score = F.col("hits") + F.when(F.col("branch"), 0.5).otherwise(0.0)
    best = candidates.withColumn("score", score).groupBy("id").agg(F.max_by(F.struct("ord", "hyp", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("id", "b.*")


def draft_glossary(pairs: DataFrame, least: int = 1) -> DataFrame:
    """(fr, en, n): for (id, fr, phrase) the most frequent phrase of each term with enough segments; of equal ones the first by code point."""
    counts = pairs.where("phrase is not null and phrase <> ''").select("id", "fr", "phrase").distinct().groupBy("fr", "phrase").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("fr").agg(F.min_by(F.struct(F.col("phrase").alias("en"), "n"), F.struct(-F.col("n"), "phrase")).alias("b")).select("fr", "b.*").where(F.col("n") >= least)


def dedup_glossary(entries: DataFrame) -> DataFrame:
    """(fr, en): the first (by pos) of entries equal in lower case."""
    place = F.row_number().over(Window.partitionBy(F.lower("fr"), F.lower("en")).orderBy("pos"))
    return entries.withColumn("place", place).where("place = 1").select("fr", "en")
