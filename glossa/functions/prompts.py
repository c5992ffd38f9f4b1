"""Text that systems and judges are given; assembly only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_line(word: Column, english: Column, tier: Column, level: Column) -> Column:
    return F.format_string("'%s' → '%s' (%s L%d)", word, english, tier, level)


def term_lines(terms: DataFrame) -> DataFrame:
    """(id, lines, phrases) of (id, pos, word, english, tier, level): lines keep repetitions, phrases don't."""
    own = F.array_sort(F.collect_list(F.struct("pos", term_line(F.col("word"), F.col("english"), F.col("tier"), F.col("level")).alias("line"), "english")))
    rows = terms.where("english is not null").groupBy("id").agg(own.alias("own"))
    return rows.select("id", F.array_join("own.line", "\n").alias("lines"), F.array_distinct("own.english").alias("phrases"))


def excerpt(text: Column, most: int) -> Column:
    """The beginning of a text, for a prompt."""
    return F.left(text, F.lit(most))
