"""An extension: the results table kept up to date from a folder of result files by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from glossa.sources.readers import RESULT


def follow_results(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Adds each new file's rows to a Parquet table by system, once per (system, id), and stops when all files are read.

    A file that is read again after a failure adds nothing: rows that the table has are left out of the batch.
    """
    rows = spark.readStream.schema(RESULT).json(folder)

    def add(batch: DataFrame, epoch: int) -> None:
        own = batch.dropDuplicates(["system", "id"])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            own = own.join(spark.read.parquet(out).select("system", "id"), ["system", "id"], "left_anti")
        own.write.mode("append").partitionBy("system").parquet(out)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
