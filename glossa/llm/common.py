"""What the operators of this subpackage share: settings, written tables, tables of a directory."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to Python. Texts have no length limit, so bytes bind: a batch ends with the row that reaches them.
#: Operators take up to fifty times the bytes in arrays.
ARROW_ROWS, ARROW_BYTES = 2048, 1 << 20

#: The white space of the word definition ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session. All operators set the same, so plans that run later aren't changed by another operator."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def release() -> None:
    """Called by tasks that end: gives what Arrow and the allocator keep back to the machine. Workers outlive their stage, and what each keeps adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with ``release`` once its batches have ended."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return ended


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a temporary folder stands in on a single machine; on a cluster, whose
    machines don't share one, that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = os.path.join(tempfile.gettempdir(), "glossa-shared")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage: a lost executor costs at most the tasks it was running,
    because the files are neither in its memory nor on its disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glossa-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes the files of a stashed table that no later plan reads."""
    path = getattr(df, "_stashed_at", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, *cols: Column) -> Column:
    """A reproducible number in [0, 2**32) from a seed and columns, the same in any SQL engine with md5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), *parts)), 1, 8), 16, 10).cast("long")
