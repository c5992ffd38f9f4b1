"""Rows of annotation sheets: aliases, ties, complete sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import norm_best, strip, tied_systems

#: Ratings that a row must have.
BITS = ("0", "1")
REGISTERS = ("DESCRIPTIVE", "TECHNICAL")


def filled(df: DataFrame, *names: str) -> Column:
    """The first alias of a column that is there and isn't blank."""
    there = [F.nullif(strip(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def normalise_rows(df: DataFrame, aliases: dict[str, tuple[str, ...]], rating: str = "human") -> DataFrame:
    """One column per field from its aliases; rows whose rating is no bit and no known register are dropped."""
    rows = df.select("pos", *[filled(df, *names).alias(field) for field, names in aliases.items()])
    return rows.where(F.col(rating).isin(*BITS) | F.upper(rating).isin(*REGISTERS))


def resolve_tie(best: Column, note: Column, llm: Column) -> Column:
    """A blank best system settled by its note: the model's choice if it is one of the tied, else the first of these; null if the note names none."""
    tied, c = F.array_sort(tied_systems(note)), norm_best(llm, "")
    settled = F.when(F.array_contains(tied, c), c).otherwise(F.try_element_at(tied, F.lit(1)))
    return F.when(norm_best(best, "") == "", settled).otherwise(norm_best(best, ""))


def complete_ids(results: DataFrame, systems: list[str]) -> DataFrame:
    """Ids for which every named system has a hypothesis that isn't blank."""
    rows = results.where(F.col("system").isin(*systems) & (strip(F.coalesce("hyp", F.lit(""))) != ""))
    return rows.groupBy("id").agg(F.countDistinct("system").alias("n")).where(F.col("n") == len(systems)).select("id")
