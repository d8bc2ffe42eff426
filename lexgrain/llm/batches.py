"""Arrow batches of bounded size for the Python operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts of 100 KB then take some 25 MB in a Python worker.
ROWS_PER_BATCH = 256


def bounded(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ROWS_PER_BATCH where it is larger or unlimited."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ROWS_PER_BATCH:
        spark.conf.set(key, ROWS_PER_BATCH)


def bounded_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows, the first by a hash of ``key``: the same for any partitioning.

    Of a larger table only about a quarter more rows than asked for are sorted, so the sort does not grow with it.
    """
    n, parts = df.count(), 1 << 30
    if n > 2 * rows:
        df = df.where(F.pmod(F.xxhash64(*key), F.lit(parts)) < F.lit(int(parts * min(1.0, 1.25 * rows / n + 100 / n))))
    return df.orderBy(F.pmod(F.xxhash64(*key), F.lit(parts)), *key).limit(rows)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """Apply ``f`` to each Arrow batch by itself; batches for which it returns None give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None and out.num_rows:
                yield out

    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)
