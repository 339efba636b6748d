"""Streams: incremental ingest of files into a catalog table, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismfold.operators.frames import dedupe
from prismfold.sources.catalog import Catalog


def ingest(spark: SparkSession, source: str, schema, catalog: Catalog, table: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch of new Parquet files; of rows with one key the last in `order` wins.

    A batch that is run again gives the same table, so the sink is idempotent.
    """

    def write(batch: DataFrame, _: int) -> None:
        catalog.upsert(table, dedupe(batch, keys, [F.col(order).desc()]), keys)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum by window and kind; on a stream, rows later than `late` are left out."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), kind, "n", "total")
