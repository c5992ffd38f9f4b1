"""Score rows and their output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_rows(manifest: DataFrame, measured: DataFrame, expected: int, fill_missing: bool = True) -> DataFrame:
    """One row per manifest label: its measures, NaN where rows are missing (or no row at all without ``fill_missing``)."""
    joined = manifest.join(measured, "label", "left")
    short = F.coalesce("n", F.lit(0)) < expected
    if not fill_missing:
        return joined.where(F.col("n") > 0)
    return joined.select(*[F.when(short, float("nan")).otherwise(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in joined.schema.fields])


def cell(value: Column, digits: int = 2) -> Column:
    """A number for a table; a dash for null, NaN and infinite values."""
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, "—").otherwise(F.format_string(f"%.{digits}f", value))


def markdown_rows(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    cells = [cell(F.col(c), digits) if df.schema[c].dataType.typeName() in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def in_category_order(rows: DataFrame, order: tuple[str, ...], category: str = "category", term: str = "term") -> DataFrame:
    """``rows`` with ``idx``, the place of their category in the order (unknown ones last), sorted by it and the term."""
    places = F.array_position(F.array(*map(F.lit, order)), F.col(category))
    return rows.withColumn("idx", F.when(places > 0, places - 1).otherwise(len(order)).cast("int")).orderBy("idx", term)


def markdown_table(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """(pos, line): head, rule and rows of ``df`` in the order of its first column."""
    spark = df.sparkSession
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))]
    lines = markdown_rows(df.orderBy(columns[0]), columns, digits)
    rows = lines.select((2 + F.monotonically_increasing_id()).alias("pos"), "line")
    return spark.createDataFrame(head, "pos long, line string").unionByName(rows)


#: Names of the systems in figures and tables.
DISPLAY = {
    "s1": "S1 NLLB",
    "s2": "S2 Mistral (doc)",
    "s3": "S3 GraphRAG",
    "s4": "S4 rerank",
    "s5": "S5 NLLB + boost",
    "s5_mistral": "S5 Mistral + boost",
    "s6": "S6 NLLB + glossary",
    "s6_mistral": "S6 Mistral + glossary",
}


def display_label(label: Column) -> Column:
    """A system's name for readers; unknown labels stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in DISPLAY.items() for x in p]), label), label)


def condition_name(folder: Column) -> Column:
    """The condition that a folder of results belongs to: its path within ``results/``."""
    return F.regexp_replace(F.regexp_replace(F.trim(folder), "^/+|/+$", ""), "^results/", "")
