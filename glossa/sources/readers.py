"""Sources: line-delimited JSON, delimited ontology files, CSV scores, text folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossa.functions.text import PLACEHOLDER, id_list, mask_prompt, split_fields, strip

SEGMENT = "id string, fr string, en_ref string, document_id string, terms array<struct<word:string>>"
RESULT = "id string, system string, fr string, hyp string, en_ref string, inference_s double"


def _exists(spark: SparkSession, path: str) -> bool:
    """Asks Hadoop's file systems, so any store that Spark reads will do."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found))


def read_results(spark: SparkSession, path: str, partial: bool = False) -> DataFrame:
    """Results; a missing file is empty, a malformed line raises or, if ``partial``, is skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).option("mode", "DROPMALFORMED" if partial else "FAILFAST").json(path)


def read_segments(spark: SparkSession, path: str, exclude: str = "") -> DataFrame:
    """Segments without the ids of a comma-separated list."""
    rows = spark.read.schema(SEGMENT).option("mode", "FAILFAST").json(path)
    ids = id_list(exclude)
    return rows.where(~F.col("id").isin(*ids)) if ids else rows


def first_rows(df: DataFrame, position: str, limit: int | None) -> DataFrame:
    """The first so many rows by an explicit position; None or 0 means all."""
    return df.orderBy(position).limit(limit) if limit else df


def last_per_id(df: DataFrame, position: str, key: str = "id") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def first_filled(*columns: str) -> Column:
    """The first alias with a value other than blank."""
    return F.coalesce(*[F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in columns])


def hypotheses(results: DataFrame) -> DataFrame:
    """(id, hyp) for neural scoring: prompt echoes, placeholders and blanks dropped."""
    hyp = strip(mask_prompt(F.col("hyp")))
    return results.select("id", hyp.alias("hyp")).where((F.col("hyp") != "") & (F.col("hyp") != PLACEHOLDER))


def detect_field(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate that is a column."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {candidates} in {df.columns}")


def aligned_pairs(df: DataFrame, sources: list[str], targets: list[str]) -> DataFrame:
    a, b = detect_field(df, sources), detect_field(df, targets)
    return df.select(strip(F.col(a)).alias("fr"), strip(F.col(b)).alias("en")).where("fr <> '' and en <> ''")


#: What windows-1252 has in place of ISO-8859-1's control characters, by Python's codec.
_CONTROLS = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}


def decode(content: Column) -> Column:
    """A whole file's text: UTF-8 (without a byte order mark) if valid, else windows-1252, or ISO-8859-1 where that lacks a byte.

    Spark decodes ISO-8859-1 itself; windows-1252 is that with other characters for some codes.
    """
    latin = F.decode(content, "ISO-8859-1")
    lacks = F.hex(content).rlike("^(..)*(81|8D|8F|90|9D)")
    pairs = [(chr(b), c) for b, c in _CONTROLS.items() if c]
    windows = F.translate(latin, "".join(a for a, _ in pairs), "".join(c for _, c in pairs))
    valid = F.is_valid_utf8(content.cast("string"))
    text = F.regexp_replace(F.decode(F.when(valid, content), "UTF-8"), "^\ufeff", "")
    return F.when(valid, text).when(lacks, latin).otherwise(windows)


def read_ontology_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, fields): lines of delimited files; the encoding is judged per file."""
    files = spark.read.format("binaryFile").load(path).select("path", decode(F.col("content")).alias("text"))
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    return lines.where(strip(F.col("line")) != "").select("file", "pos", split_fields(F.col("line")).alias("fields"))


def level_entries(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("fields") >= 2).select("file", "pos", F.col("fields")[0].alias("code"), F.col("fields")[1].alias("name"))


def code_pairs(rows: DataFrame) -> DataFrame:
    a, b = F.col("fields")[0], F.try_element_at("fields", F.lit(2))
    return rows.where(a.rlike("^[0-9]+$") & b.rlike("^[0-9]+$")).select(a.alias("parent"), b.alias("child"))


def read_scores(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV scores: text columns as they are, others as doubles; empty and ``nan`` cells are null."""
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    text = {"label", "display"}
    return raw.select(*[F.col(c) if c in text else F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double")).alias(c) for c in raw.columns])


def discover(spark: SparkSession, glob: str) -> DataFrame:
    """Lines of all files of a glob with the file's stem as ``label``."""
    return spark.read.text(glob).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("label"), "value")


def count_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that aren't blank, and their 90/10 split."""
    n = lines.agg(F.count(F.when(strip(F.col(value)) != "", 1)).alias("lines"))
    return n.select("lines", F.floor(F.col("lines") * 0.9).alias("train"), (F.col("lines") - F.floor(F.col("lines") * 0.9)).alias("held_out"))


def pending(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id has no result yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def aligned(results: DataFrame, references: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, hyp, ref[, src]) of results whose id has a reference (and a source): the input of reference metrics, by id."""
    key = F.col("id").cast("string").alias("id")
    rows = results.select(key, "hyp").join(references.select(key, "ref"), "id")
    return rows if sources is None else rows.join(sources.select(key, "src"), "id")


def in_order(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of the listed ids (id, pos), with ``pos``; ids without a row are left out."""
    return ids.select("id", "pos").join(rows, "id").orderBy("pos")


def read_code_map(spark: SparkSession, path: str, value: int, numeric: bool = False) -> DataFrame:
    """(code, value) of delimited files without a head line: column 0 to column ``value``; the last line of a code wins, of several files that of the last name."""
    rows = read_ontology_file(spark, path).select("file", "pos", F.col("fields")[0].alias("code"), F.try_element_at("fields", F.lit(value + 1)).alias("value"))
    rows = rows.where(F.col("code").rlike("^[0-9]+$") & (F.col("value") != ""))
    rows = rows.where(F.col("value").rlike("^[0-9]+$")) if numeric else rows
    return rows.groupBy("code").agg(F.max_by("value", F.struct("file", "pos")).alias("value"))
