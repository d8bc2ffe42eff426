"""Streams that keep state and give it back: deduplicated appends, a log joined to its feedback, counts of closed windows.

State goes once the watermark, ``late`` behind the newest time seen, has passed what it waits for; rows that come later than that are
left out. Output is appended by the file sink, whose log makes each batch count once, so a query may be stopped and started again at
any point on its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, folder: str, schema, pattern: str | None = None, each: int | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream; ``each`` files a batch at most."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", each) if each else reader).parquet(folder)


def deduplicated(rows: DataFrame, time: str, late: str, *key: str) -> DataFrame:
    """Of the rows of a key that come within ``late`` of each other, the first one; keys are forgotten after that. ``time`` is no null."""
    return rows.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def with_feedback(log: DataFrame, feedback: DataFrame, key: str, asked: str, given: str, within: str, late: str) -> DataFrame:
    """Rows of ``log`` joined to the ``feedback`` of their key that is given ``within`` an interval after they were asked.

    Both may come in any order, ``late`` at most: the state of either side goes when the other can no longer meet it.
    """
    one = log.where(F.col(asked).isNotNull()).withColumn(asked, F.col(asked).cast("timestamp")).withWatermark(asked, late)
    two = feedback.where(F.col(given).isNotNull()).withColumn(given, F.col(given).cast("timestamp")).withColumnRenamed(key, "_key").withWatermark(given, late)
    near = (F.col(given) >= F.col(asked)) & (F.col(given) <= F.col(asked) + F.expr(f"interval {within}"))
    return one.join(two, (F.col(key) == F.col("_key")) & near).drop("_key")


def closed_windows(events: DataFrame, time: str, by: str, length: str, late: str) -> DataFrame:
    """Counts per tumbling window and value of ``by``, each once, when its window can no longer change."""
    own = events.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.window(time, length), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come since the last run on this checkpoint to the table at ``path``, then stops."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
