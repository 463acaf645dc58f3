"""Streams of documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.literate import read_literate
from ..sources.store import Store


def ingest_documents(spark: SparkSession, folder: str, store: Store, name: str, checkpoint: str):
    """A query that merges documents arriving in ``folder`` into a stored graph; merging is idempotent, so a batch run twice does no harm."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.put(name, read_literate(spark, batch, graph=name))

    texts = spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.sha2("value", 256).alias("name"), F.col("value").alias("text"))
    return texts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums of events by type and tumbling window, late ones within ``late`` included; for streams and tables alike."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
