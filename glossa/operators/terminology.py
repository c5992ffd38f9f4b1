"""Terminology metrics; all are aggregates of one scored table of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.similarity import cosine
from glossa.functions.text import casefolded, norm_metric


def found_rendering(text: Column, renderings: Column) -> Column:
    """The first rendering that the text (both normalised) contains; null if none."""
    return F.try_element_at(F.filter(renderings, lambda r: (r != "") & F.contains(text, r)), F.lit(1))


def span_score(found: Column, target_level: Column, own_level: Column, same_branch: Column) -> Column:
    """0 if nothing is found or known, 1 on the same level, one half in the same branch."""
    return F.when(found.isNull(), 0.0).when(target_level.isNull(), 0.0).when(target_level == own_level, 1.0).when(F.coalesce(same_branch, F.lit(False)), 0.5).otherwise(0.0)


def _weight(scored: DataFrame) -> Column:
    """How often a row's span occurs: its column ``c``, else once."""
    return F.col("c") if "c" in scored.columns else F.lit(1)


def mean_or(score: Column, weight: Column, default: float) -> Column:
    return F.coalesce(F.sum(score * weight) / F.sum(F.when(score.isNotNull(), weight)), F.lit(default))


def _total(weight: Column) -> Column:
    return F.coalesce(F.sum(weight), F.lit(0)).cast("long")


def _once(scored: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each segment's distinct spans by case-folded word; of equal ones the first place (column ``pos``, where there is one) counts."""
    place = F.struct(*[c for c in ("pos", "word") if c in scored.columns])
    kept = [c for c in ("grounded", "score", "ref_score") if c in scored.columns]
    rows = scored.groupBy(*by, "id", casefolded(F.col("word")).alias("_word")).agg(F.min_by(F.struct(*kept), place).alias("x"))
    return rows.select(*by, "x.*")


def htm(scored: DataFrame, *by: str) -> DataFrame:
    """Mean score of grounded spans; 0 without any."""
    w = _weight(scored)
    return scored.where("grounded").groupBy(*by).agg(_total(w).alias("spans"), mean_or(F.col("score"), w, 0.0).alias("htm"))


def htm_reference(scored: DataFrame, *by: str) -> DataFrame:
    """Mean over the distinct spans of each segment, ungrounded ones as 0."""
    rows = _once(scored, by)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("spans"), F.coalesce(F.avg(F.when(F.col("grounded"), F.col("score")).otherwise(0.0)), F.lit(0.0)).alias("htm"))


def agreement(scored: DataFrame, *by: str) -> DataFrame:
    """Mean of 1 - |score of hypothesis - score of reference| over distinct grounded spans; NaN without any."""
    rows = _once(scored.where("grounded"), by)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("spans"), F.coalesce(F.avg(1 - F.abs(F.col("score") - F.col("ref_score"))), F.lit(float("nan"))).alias("agreement"))


def level_accuracy(scored: DataFrame, *by: str) -> DataFrame:
    """Share of found spans whose level is the source's; NaN without any."""
    w = _weight(scored)
    return scored.where("grounded and found is not null").groupBy(*by).agg(_total(w).alias("spans"), mean_or((F.col("found_level") == F.col("level")).cast("double"), w, float("nan")).alias("hra"))


def missing_rate(scored: DataFrame, *by: str) -> DataFrame:
    lost, w = F.col("found").isNull(), _weight(scored)
    return scored.where("grounded").groupBy(*by).agg(
        _total(w).alias("grounded_spans"), _total(F.when(lost, w)).alias("missing_spans"), mean_or(lost.cast("double"), w, float("nan")).alias("missing_rate")
    )


def drift(scored: DataFrame, *by: str, least: int = 3) -> DataFrame:
    """Per term with enough occurrences: (distinct renderings - 1) / (occurrences - 1); a missing rendering is one of its own."""
    one = F.coalesce(norm_metric(F.col("found"), wide=False), F.lit("__none__"))
    rows = scored.where("grounded").groupBy(*by, "word").agg(_total(_weight(scored)).alias("n"), F.countDistinct(one).alias("renderings")).where(F.col("n") >= least)
    return rows.withColumn("drift", (F.col("renderings") - 1) / F.greatest(F.col("n") - 1, F.lit(1)))


def modal_agreement(scored: DataFrame, *by: str) -> DataFrame:
    """Per term: the share of its most frequent rendering."""
    counts = scored.where("grounded").groupBy(*by, "word", F.coalesce("found", F.lit("__none__")).alias("rendering")).agg(_total(_weight(scored)).alias("k"))
    return counts.groupBy(*by, "word").agg(F.sum("k").alias("n"), (F.max("k") / F.sum("k")).alias("modal_rate"))


def level_distribution(scored: DataFrame, *by: str) -> DataFrame:
    w = _weight(scored)
    return scored.where("grounded and found is not null").groupBy(*by, "level", "found_level").agg(_total(w).alias("n"), _total(F.when(F.col("found_level") < F.col("level"), w)).alias("flattened"))


def surface_rate(scored: DataFrame) -> DataFrame:
    """By length of the term in words (1, 2, 3 or more): how often it stands in the text as it is."""
    size = F.least(F.size(F.split("word", " ")), F.lit(3))
    return scored.groupBy(size.alias("words")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.contains("text", F.col("word")).cast("long")).alias("verbatim"))


def vector_scores(chunks: DataFrame, renderings: DataFrame, threshold: float) -> DataFrame:
    """(key, score): of (key, vector) chunks and (key, vector, align) renderings the alignment of the closest pair, 0 below the threshold.

    Pairs are formed within a key (one span's chunks and renderings) and reduced in the same step.
    """
    rows = chunks.select("key", F.col("vector").alias("cv"), F.col("pos").alias("cpos")).join(renderings.select("key", F.col("vector").alias("rv"), F.col("pos").alias("rpos"), "align"), "key")
    rows = rows.select("key", "cpos", "rpos", "align", cosine(F.col("cv"), F.col("rv")).alias("sim"))
    best = rows.groupBy("key").agg(F.max("sim").alias("sim"), F.max_by("align", F.struct("sim", -F.col("cpos"), -F.col("rpos"))).alias("align"))
    return best.select("key", "sim", F.when(F.col("sim") < threshold, 0.0).otherwise(F.col("align")).alias("score"))
