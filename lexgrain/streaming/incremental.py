"""Incremental indexing and event logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import append_new


def index_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, *key: str, pattern: str | None = None) -> StreamingQuery:
    """Reads what is new in ``source`` once and appends unknown keys to ``target``; running it again adds nothing."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)

    def add(batch: DataFrame, _: int) -> None:
        append_new(batch, target, *key)

    return reader.parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, length: str, late: str) -> DataFrame:
    """Counts per tumbling window and value of ``by``; rows later than ``late`` are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")
