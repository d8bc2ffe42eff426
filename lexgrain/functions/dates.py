"""Date windows for incremental loads and backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = {"month": 1, "quarter": 3, "year": 12, "decade": 120}


def windows(spark: SparkSession, first: str, last: str, unit: str) -> DataFrame:
    """(window_start, window_end) of the calendar units that start from ``first`` to ``last``, ends inclusive."""
    months = STEPS[unit]
    starts = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval {months} month)")).alias("window_start"))
    return starts.withColumn("window_end", F.date_sub(F.add_months("window_start", months), 1))


def rolling(spark: SparkSession, today: str, days: int = 60) -> DataFrame:
    return spark.range(1).select(F.date_sub(F.lit(today).cast("date"), days).alias("window_start"), F.lit(today).cast("date").alias("window_end"))
