"""Structured Streaming: ingestion of documents in batches, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import scratch


def ingest(corpus, folder: str, schema: str, checkpoint: str | None = None) -> None:
    """Add all Parquet files of ``folder`` (title, text) that weren't added before; a repeated batch is skipped."""
    stream = corpus.spark.readStream.schema(schema).parquet(folder)
    q = stream.writeStream.foreachBatch(lambda df, i: corpus.add(df.select("title", "text"), batch_id=int(i))).option("checkpointLocation", checkpoint or scratch(corpus.spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_events(spark: SparkSession, events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by tumbling window and type; on a stream with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
