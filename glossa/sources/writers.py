"""Sinks; each writes what readers of the same kind take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a table of scores, in order; vector columns stand between the two parts.
SCORES = ["label", "display", "bleu", "chrf", "bleu_doc_macro", "bleu_doc_concat", "chrf_doc_macro", "comet", "htm", "htm_hyp_ref_agreement"]
DATASET_SCORES = ["htm_en_ref_dataset", "ccr_dataset", "mean_s", "p95_s"]


def write_results(df: DataFrame, path: str) -> None:
    """Line-delimited JSON by system; appended, so that a resumed run adds to it."""
    df.write.mode("append").partitionBy("system").json(path)


def write_scores(rows: DataFrame, ccr: DataFrame, path: str) -> None:
    """Score rows in a fixed column order, vector columns (sorted) before those of the data set, with the data set's coverage in each row."""
    wide = rows.drop("ccr_dataset").crossJoin(F.broadcast(ccr))  # one row
    vectors = sorted(c for c in rows.columns if c.startswith("htm_vector_"))
    columns = [c for c in [*SCORES, *vectors, *DATASET_SCORES] if c in wide.columns]
    wide.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def write_graph(concepts: DataFrame, edges: DataFrame, path: str) -> None:
    """Replaces both tables."""
    concepts.write.mode("overwrite").parquet(f"{path}/concepts")
    edges.distinct().write.mode("overwrite").parquet(f"{path}/edges")


def write_coverage(df: DataFrame, path: str, conditions: list[str] | None = None) -> None:
    """Finite values of known conditions (column ``label``; all without a list), rounded to six places."""
    v = F.col("ccr")
    df = df if conditions is None else df.where(F.col("label").isin(conditions))
    df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).withColumn("ccr", F.round(v, 6)).write.mode("overwrite").json(path)


def cached(path: str, compute: Callable[[], DataFrame], recompute: bool = False) -> DataFrame:
    """A table kept as Parquet; computed if it isn't there or if asked. Its age is not looked at."""
    from pyspark.sql import SparkSession

    from glossa.sources.readers import _exists

    spark = SparkSession.getActiveSession()
    if recompute or not _exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def refresh_texts(audit: DataFrame, segments: DataFrame, hyps: DataFrame) -> DataFrame:
    """An audit table with its texts filled again from the sources; annotations stay, unknown ids stay as they are, a missing hypothesis is empty."""
    own = segments.select("id", F.col("fr").alias("new_fr"), F.col("en_ref").alias("new_ref"), F.lit(True).alias("known"))
    joined = audit.join(own, "id", "left").join(hyps.select("id", F.col("hyp").alias("new_hyp")), "id", "left")
    new = {"fr": F.col("new_fr"), "en_ref": F.col("new_ref"), "hyp": F.coalesce("new_hyp", F.lit(""))}
    return joined.select(*[F.when(F.col("known"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in audit.columns])


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a head line in a folder of its name (agreement, adjudication, overall figures)."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
