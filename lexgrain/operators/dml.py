"""Data changes as DataFrames: what a table holds afterwards. Writing it is a separate call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_rows(new: DataFrame, old: DataFrame, *key: str) -> DataFrame:
    """Rows of ``new`` whose key ``old`` does not have; of several with one key, one. Inserting twice changes nothing."""
    return new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, update: list[str]) -> DataFrame:
    """``old`` after inserting ``new`` by key; existing rows take only the columns ``update``."""
    n = new.select(F.col(key), F.struct(*[F.col(c) for c in old.columns]).alias("_new")).dropDuplicates([key])
    both = old.select(F.col(key), F.struct(*[F.col(c) for c in old.columns]).alias("_old")).join(n, key, "full")
    pick = lambda c: F.when(F.col("_old").isNull() | (F.col("_new").isNotNull() if c in update else F.lit(False)), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return both.select(*[pick(c).alias(c) for c in old.columns])


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """``old`` without the rows of the parents that ``new`` brings, and with ``new``."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def replace_source(old: DataFrame, new: DataFrame, column: str, source: str) -> DataFrame:
    """Delete by source, then append: idempotent, in any order of sources."""
    return old.where(~F.col(column).eqNullSafe(source)).unionByName(new.where(F.col(column) == source))


def last_write(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row of the largest ``order``; full ties are settled by all columns."""
    rest = [F.col(c) for c in rows.columns if c not in (key, order)]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), *rest))).where("_n = 1").drop("_n")


def fill(old: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` set from ``values`` (key, column) where it is given there."""
    v = values.select(key, F.col(column).alias("_v")).dropDuplicates([key])
    return old.join(v, key, "left").withColumn(column, F.coalesce("_v", column)).select(*old.columns)


def cascade_delete(children: DataFrame, gone: DataFrame, parent: str) -> DataFrame:
    return children.join(gone.select(parent).distinct(), parent, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is missing; a null key is no orphan."""
    own = children.where(F.col(child_key).isNotNull())
    return own.join(parents.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def log_rows(queries: DataFrame) -> DataFrame:
    """Query-log rows with an id; success means results and no error. Elapsed to 3 decimals; token usage is null where unknown."""
    usage = {c: F.lit(None).cast("int") for c in ("input_tokens", "output_tokens", "total_tokens") if c not in queries.columns}
    return queries.withColumns(
        usage
        | {"id": F.expr("uuid()"), "retrieval_success": (F.coalesce("source_count", F.lit(0)) > 0) & F.col("error_message").isNull(), "response_time_seconds": F.round("response_time_seconds", 3)}
    )


def with_feedback(log: DataFrame, feedback: DataFrame, key: str, order: str) -> DataFrame:
    """``log`` with the latest feedback of each row (null without any)."""
    last = last_write(feedback.select(key, order, "feedback"), key, order)
    return log.join(last.select(key, "feedback"), key, "left")
