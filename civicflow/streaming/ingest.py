"""Structured Streaming: messages that arrive as files, told apart by identity, counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from civicflow.functions import text as T

MESSAGE = "source string, external_id string, text string, published_at timestamp, url string"


def read_messages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New JSON files of a folder as a stream; the checkpoint of the query holds what was read."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def first_deliveries(messages: DataFrame, late: str = "30 days") -> DataFrame:
    """Each (source, external_id) once within the watermark; state of older identities is dropped."""
    keyed = messages.withColumn("identity", T.identity_digest(F.col("source"), F.col("external_id")))
    return keyed.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["identity"])


def counts_per_window(messages: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, source, n) per window; a window is final once the watermark has passed it."""
    windows = messages.withWatermark("published_at", late).groupBy(F.window("published_at", width).alias("w"), "source").agg(F.count(F.lit(1)).alias("n"))
    return windows.select(F.col("w.start").alias("start"), "source", "n")


def append_to(messages: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once through its checkpoint."""
    writer = messages.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
