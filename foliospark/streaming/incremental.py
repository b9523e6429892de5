"""Incremental chunking as a stream: new and changed files are chunked once, whatever runs again.

The state is a table of content keys; each micro-batch is anti-joined to it and both outputs carry the batch's number,
so a batch that is run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import chunking


def content_key(docs: DataFrame) -> DataFrame:
    """docs with the key of name and content that decides whether a file was seen."""
    return docs.withColumn("content_key", F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))))


def _state(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """Keys of all batches but this one.  A folder that isn't there yet is an empty state; a damaged one raises."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content_key string")
    return spark.read.schema("content_key string, batch long").parquet(path).filter(F.col("batch") != batch).select("content_key")


def ingest(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str) -> None:
    """Chunk all documents in the folder ``source`` that weren't there before; returns when it has caught up."""

    def write(batch: DataFrame, number: int) -> None:
        keyed = content_key(batch).dropDuplicates(["content_key"])
        new = keyed.join(_state(spark, f"{out}/state", number), "content_key", "left_anti")
        chunks = chunking.chunk_recursive(new)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        new.select("content_key").write.mode("overwrite").parquet(f"{out}/state/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
