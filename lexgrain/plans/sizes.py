"""Broadcasts behind a check of their size, and Arrow batches of bounded bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may have.
MOST_ROWS = 100_000
#: Rows of one part of a shuffle.
PART_ROWS = 1_000_000
#: Bytes of one Arrow batch.
BATCH_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has ``most`` rows at most; else as it is, and Spark joins it by a shuffle or in blocks."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, *by: str, most: int = PART_ROWS) -> DataFrame:
    """``df`` dealt by ``by`` into parts of about ``most`` rows, but no fewer parts than shuffles are set to make: what a task holds does not
    grow with the table. The rows are counted first, so ``df`` should be a table that is read or stored.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-df.count() // most)), *by)


def bounded_bytes(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lower the session's bytes of an Arrow batch to ``most`` where they are more: rows that hold whole blocks then come a few at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str((1 << 31) - 1)).rstrip("bB")) > most:
        spark.conf.set(key, most)
