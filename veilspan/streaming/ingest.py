"""Streams of documents and events through the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspan.operators.detect import detect, pages_of_documents

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def detect_stream(documents: DataFrame, output: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes the merged findings of arriving documents. A document is whole within a batch, so the batch operators, joins and all, run on each batch.

    A batch that runs again overwrites its own folder, so results are written once.
    """
    own = transform or (lambda batch: detect(pages_of_documents(batch), F.col("lang")))

    def run(batch: DataFrame, number: int) -> None:
        own(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_documents(documents: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Documents whose fingerprint hasn't come within the watermark."""
    named = documents.withColumn("fingerprint", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).withWatermark(time, late)
    return named.dropDuplicatesWithinWatermark(["fingerprint"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, event_type, n, total): events in tumbling or sliding windows, late ones up to the watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): sessions of users, which end after a gap."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
