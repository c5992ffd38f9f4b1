"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import (
    byte_bpe, chat_snapshots, collocations, embedding_dedup, html_text, lexical_search, media_sequence, minhash_dedup, secret_scan, source_mix, token_files, toxicity, url_lists,
)
from glossa.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and split pattern of a public vocabulary; imported here as only these queries need it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = source_mix.mix(docs, F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def source_mix_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts, each a member of all sources that have it, so the flow has a choice of quotas."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    texts = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.collect_set("source").alias("members"))
    texts = docs.select("doc_id", "text").join(texts.select("doc_id", "members"), "doc_id")
    mixed = source_mix.mix(texts.withColumn("members", F.array_sort("members")), F.col("members"))
    return mixed.select("doc_id", "size", F.size("members").alias("n_sources"), "taken", F.array_join("credits", ",").alias("credits"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_file()
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), path, pattern)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.collapse(chat_snapshots.sample_log(table(spark, sf_dir, "conversations")))


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_lists.sample_captures(table(spark, sf_dir, "pages"))
    return url_lists.judge(captures, url_lists.sample_entries(captures))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_media_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_sequence.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def media_sequence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, with a figure of its own markup added behind it, as its items in order; figures resolve to the stored payloads."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    told = media_sequence.describe(media_sequence.store(pages, "html"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.sha2(media_sequence.payload(F.col("html")), 256), F.lit('"><figcaption>page '), F.col("page_id").cast("string"), F.lit("</figcaption></figure>"))
    return media_sequence.page_items(pages.withColumn("html", F.concat("html", figure)), told)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = tokenizer_file("byte_bpe_50k.json")
    return token_files.read(spark, token_files.write(table(spark, sf_dir, "documents"), path))


def queries() -> dict[str, Query]:
    return {
        "op1_source_mix": op1_source_mix,
        "op2_toxicity": op2_toxicity,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_html_text": op4_html_text,
        "op5_chat_snapshots": op5_chat_snapshots,
        "op6_url_lists": op6_url_lists,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_media_sequence": op8_media_sequence,
        "op9_secret_scan": op9_secret_scan,
        "op10_minhash_dedup": op10_minhash_dedup,
        "op11_collocations": op11_collocations,
        "op12_lexical_search": op12_lexical_search,
        "op13_token_files": op13_token_files,
        "source_mix_overlapping": source_mix_overlapping,
        "media_sequence_pages": media_sequence_pages,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_snapshots": chat_snapshots.ORACLE_SQL, "op6_url_lists": url_lists.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_lexical_search": lexical_search.ORACLE_SQL}
