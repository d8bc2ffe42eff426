"""A global order without a task that sees all rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import stored

#: monotonically_increasing_id counts the rows of a partition in its lower bits.
_BITS = 33


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle is set to make: chosen for the cluster, not by the rows of a table."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt and sorted by ``by`` and persisted (memory, else local disk), for loops that join it again and again on ``by``.

    Joins need no exchange and no sort of it, and read columns where a checkpoint's rows are deserialised one by one. What an executor
    loses is made again. It is filled here, as joins know its order only then, and is for the caller to unpersist.
    """
    out = df.repartition(partitions(df.sparkSession), *by).sortWithinPartitions(*by).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``df`` with each row's place, from 1, in ``order``; which of two rows that tie in all of it comes first is open.

    Ranges of the order are sorted apart and stored; a range's first place is the number of rows in the ranges before it.
    """
    spark = df.sparkSession
    placed = stored(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", _BITS)
    before, starts = 0, []
    for p, n in sorted(placed.groupBy(part.alias("p")).count().collect()):  # one row a partition
        starts.append((p, before))
        before += n
    if not starts:
        return placed.withColumn(name, F.lit(None).cast("long")).drop("_at")
    ranges = spark.createDataFrame(starts, "_part long, _before long")
    joined = placed.withColumn("_part", part).join(F.broadcast(ranges), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1).drop("_at", "_part", "_before")
