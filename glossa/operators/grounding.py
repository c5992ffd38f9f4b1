"""Grounding of surface forms to concepts: exact by key, then fuzzy by blocked similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossa.functions.similarity import LabelMasks, indel_ratio
from glossa.functions.text import is_malformed_term, norm_key

CUTOFF = 90
#: Largest label index (rows) that may be broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 500_000
#: Tiers whose labels the fuzzy stage takes.
FUZZY_TIERS = ("PT", "LLT")


def sent_if_small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` marked to be broadcast if they are at most so many; kept, so that they are computed once. Larger ones are joined by shuffle."""
    rows = rows.persist()
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def label_index(concepts: DataFrame, label: str = "fr_label") -> DataFrame:
    """(key, n_concepts, is_ambiguous, concept): one row per key; the first concept by level, then id, stands for it."""
    rows = concepts.where(F.col(label).isNotNull()).withColumn("key", norm_key(F.col(label), wide=False)).where("key != ''")
    first = F.min_by(F.struct("id", "name", "level", "tier"), F.struct("level", "id"))
    return rows.groupBy("key").agg(F.countDistinct("id").alias("n_concepts"), first.alias("concept")).withColumn("is_ambiguous", F.col("n_concepts") > 1)


def fuzzy_index(concepts: DataFrame, label: str = "fr_label") -> DataFrame:
    """The index of the fuzzy stage: as the reference's, of the two lowest tiers only."""
    return label_index(concepts.where(F.col("tier").isin(*FUZZY_TIERS)), label)


def ground_exact(terms: DataFrame, index: DataFrame, word: str = "word") -> DataFrame:
    """``terms`` with the columns of the index (null where no label equals). Distinct words are keyed once."""
    words = terms.select(word).distinct().withColumn("key", norm_key(F.col(word)))
    found = words.join(index, "key").drop("key")
    return terms.join(found, word, "left")


def fuzzy_candidates(words: DataFrame, keys: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(word key, label key) pairs that can reach the cutoff, by the pieces that a few insertions and deletions leave whole.

    A ratio of c needs a common subsequence of c * (a + b) / 200 characters, so at most
    d = floor(a + b - c * (a + b) / 100) insertions and deletions. Each of these spoils one
    character of a string; of a word cut into d + 1 pieces at least one is untouched, and it stands in the label
    at most d places off. Pieces are joined by equality with the label's substrings, so no pair is formed
    without a common piece.
    """
    a = words.select(F.col("key").alias("word_key")).distinct().where("word_key != ''").withColumn("n", F.length("word_key"))
    b = keys.select(F.col("key").alias("label_key")).distinct().where("label_key != ''").withColumn("m", F.length("label_key"))
    share = (100 - cutoff) / 100
    # The longest label that fits a word of n characters has n * (200 - c) / c characters.
    longest = F.floor(F.col("n") * (200 - cutoff) / cutoff)
    d = F.floor((F.col("n") + longest) * share + 1e-9).cast("int")
    a = a.withColumn("d", F.least(d, F.col("n") - 1))
    cut = F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.struct(
        F.floor(i * F.col("n") / (F.col("d") + 1)).cast("int").alias("at"),
        (F.floor((i + 1) * F.col("n") / (F.col("d") + 1)) - F.floor(i * F.col("n") / (F.col("d") + 1))).cast("int").alias("size")))
    pieces = a.withColumn("p", F.explode(cut)).select("word_key", "n", "d", F.col("p.at").alias("at"), F.substring("word_key", F.col("p.at") + 1, F.col("p.size")).alias("piece"), F.col("p.size").alias("size"))
    # Only the sizes that words have, a handful.
    sizes = pieces.agg(F.collect_set("size").alias("sizes"))
    grams = b.crossJoin(F.broadcast(sizes)).withColumn("size", F.explode("sizes")).where("size <= m").withColumn("at_label", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("size"))))
    grams = grams.select("label_key", "m", "size", "at_label", F.substring("label_key", F.col("at_label") + 1, F.col("size")).alias("piece"))
    used = pieces.select("piece").distinct()
    grams = grams.join(used, "piece", "left_semi")
    fits = (F.abs(F.col("at_label") - F.col("at")) <= F.col("d")) & (F.least("n", "m") * 200 >= cutoff * (F.col("n") + F.col("m")))
    return pieces.join(grams.drop("size"), "piece").where(fits).select("word_key", "label_key").distinct()


def fuzzy_matches(words: DataFrame, index: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(word_key, label_key, score): all pairs with an Indel ratio of the cutoff or more.

    Up to ``BROADCAST_ROWS`` labels go to the executors, where each word meets all that can reach the cutoff;
    low cutoffs leave pieces of a letter or two, by which the join would form nearly all pairs as rows.
    """
    labels = [r.key for r in index.select("key").where("key != ''").distinct().limit(BROADCAST_ROWS + 1).collect()]
    if len(labels) <= BROADCAST_ROWS:
        return _matched(words, labels, cutoff)
    pairs = fuzzy_candidates(words, index, cutoff)
    return pairs.withColumn("score", indel_ratio(F.col("word_key"), F.col("label_key"))).where(F.col("score") >= cutoff)


def _matched(words: DataFrame, labels: list[str], cutoff: float) -> DataFrame:
    """``fuzzy_matches`` against labels that are held in the executors."""
    spark = words.sparkSession
    shipped = spark.sparkContext.broadcast(sorted(labels))
    own = words.select(F.col("key").alias("word_key")).where("word_key != ''").distinct()
    # Few bytes, much work: a stated number of tasks. Dealt by the word itself they would be those of the step before, which are put together by size.
    own = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("word_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = labels = None
        for batch in batches:
            if masks is None:
                masks = LabelMasks(shipped.value)
                labels = pa.array(masks.labels, pa.string())
            asked = batch.column(0).to_pylist()
            found = list(masks.matches_of(asked, cutoff))
            i, j, score = (np.concatenate([f[k] for f in found] or [np.zeros(0, t)]) for k, t in enumerate((np.int64, np.int64, np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), labels.take(pa.array(j)), pa.array(score)], names=["word_key", "label_key", "score"])

    return own.mapInArrow(run, "word_key string, label_key string, score double")


def best_matches(matches: DataFrame, limit: int = 1) -> DataFrame:
    """The best so many labels of each word; ties by label."""
    place = F.row_number().over(Window.partitionBy("word_key").orderBy(F.desc("score"), "label_key"))
    return matches.withColumn("place", place).where(F.col("place") <= limit)


def ground(terms: DataFrame, index: DataFrame, word: str = "word", cutoff: float = CUTOFF, near: DataFrame | None = None) -> DataFrame:
    """(word, key, match, score, concept): exact first (even if ambiguous), then fuzzy for what is left, by the index ``near`` where one is given; distinct words."""
    near = index if near is None else near
    words = terms.select(F.col(word).alias("word")).distinct().withColumn("key", norm_key(F.col("word"))).where("key != ''")
    exact = words.join(index, "key", "left").select("word", "key", "concept", "is_ambiguous", "n_concepts").persist()  # so that texts are cut into words once
    rest = exact.where("concept is null").select("key")
    fuzzy = best_matches(fuzzy_matches(rest, near, cutoff)).select(F.col("word_key").alias("key"), F.col("label_key"), "score")
    fuzzy = fuzzy.join(near.select(F.col("key").alias("label_key"), F.col("concept").alias("near")), "label_key")
    joined = exact.join(fuzzy.select("key", "near", "score", "label_key"), "key", "left")
    match = F.when(F.col("concept").isNotNull(), "exact").when(F.col("near").isNotNull(), "fuzzy").otherwise("none")
    return joined.select("word", "key", match.alias("match"), F.when(F.col("concept").isNotNull(), 100.0).otherwise(F.col("score")).alias("score"), F.coalesce("concept", "near").alias("concept"), F.coalesce("is_ambiguous", F.lit(False)).alias("is_ambiguous"))


def coverage(grounded: DataFrame, *by: str) -> DataFrame:
    """Terms, grounded terms and their share (0 without terms)."""
    hit = F.col("concept").isNotNull()
    return grounded.groupBy(*by).agg(F.count(F.lit(1)).alias("terms"), F.sum(hit.cast("long")).alias("grounded"), F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("ccr"))


CATEGORIES = ("AMBIGUOUS", "NOT_IN_GRAPH", "EXACT_HIT", "FUZZY_HIT")


def diagnose(terms: DataFrame, index: DataFrame, word: str = "word", cutoff: float = CUTOFF, near: DataFrame | None = None) -> DataFrame:
    """(term, category, freq): ambiguity comes before grounding; malformed terms are left out."""
    freq = terms.where(F.col(word).isNotNull() & ~is_malformed_term(F.col(word))).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("freq")).persist()
    found = ground(freq, index, "word", cutoff, near)
    category = F.when(F.col("is_ambiguous"), "AMBIGUOUS").when(F.col("match") == "none", "NOT_IN_GRAPH").when(F.col("match") == "exact", "EXACT_HIT").otherwise("FUZZY_HIT")
    return freq.join(found, "word").select(F.col("word").alias("term"), category.alias("category"), "freq")


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, halves to even."""
    return F.bround(100 * part / whole).cast("int")
