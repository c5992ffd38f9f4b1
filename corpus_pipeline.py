"""From raw documents to token counts of a mixed corpus: five stages, each written and read again.

Toxic documents go, one document of each group of near-duplicates stays, secrets are masked, sources are mixed to
their target weights (documents taken more than once repeat), and what is left is encoded.

All stages but the last return the columns of their documents, with the user's values: columns whose names an operator uses itself
travel in a struct. Every stage takes rows with nulls in any column, repeated rows, texts of any length and empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import byte_bpe, minhash_dedup, secret_scan, source_mix, toxicity
from glossa.llm.common import discard, stash, table
from glossa.llm.queries import tokenizer_file


def _packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that an operator reads, and all others in one struct, where no name of the operator's own can meet them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(F.struct(*others, F.lit(None).alias("_none")).alias("_others"), *used)


def _unpacked(docs: DataFrame, used: tuple[str, ...], changed: dict[str, Column] | None = None) -> list[Column]:
    """The columns of ``docs`` again, in their order."""
    changed = changed or {}
    return [changed.get(c, F.col(c) if c in used else F.col("_others")[c]).alias(c) for c in docs.columns]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what scores as toxic; learns from the labels of the rows that ``op2`` learns from.

    Null and empty texts have no toxic window and stay; repeated rows get one score each, the same; without labels of both classes
    all rows stay unless all labels are toxic.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(_packed(docs, "text"), model).where("predicted = 0").select(*_unpacked(docs, ("text",)))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group.

    Rows without an id and documents without words stay; repeated rows of a kept id all stay, as they are one document.
    """
    gone = minhash_dedup.near_duplicates(docs.select("doc_id", "text")).where("doc_id is not null and not kept").select(F.col("doc_id").alias("gone")).distinct()
    gone = stash(gone, "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; ``n_chars`` of a changed text is its new length. Null and empty texts stay as they are."""
    used = ("text", "n_chars") if "n_chars" in docs.columns else ("text",)
    masked = secret_scan.scan(_packed(docs, *used), with_redacted=True)
    hit = F.size("secret_spans") > 0
    changed = {"text": F.when(hit, F.col("redacted")).otherwise(F.col("text"))}
    if "n_chars" in used:
        changed["n_chars"] = F.when(hit, F.length("redacted")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return masked.select(*_unpacked(docs, used, changed))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix says, one row each time; null sources are a source, documents without words are not taken."""
    used = ("doc_id", "text", "source")
    mixed = source_mix.mix(_packed(docs, *used), F.array("source"))
    return mixed.where(F.size("credits") > 0).withColumn("_pass", F.explode("credits")).select(*_unpacked(docs, used))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row; a null text has no tokens."""
    path, pattern = tokenizer_file()
    return byte_bpe.encode_decode(docs.select("doc_id", "text"), path, pattern)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("secret_scan", secret_stage),
    ("source_mix", mix_stage),
    ("byte_bpe", encode_stage),
]

#: Compression, flows and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = stash(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
