"""Readers: JSONL documents, edge lists, gold sets, cached pages, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import GOLD, JSONL


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_files(spark: SparkSession, folder: str, name: str) -> tuple[str, str]:
    """(folder, pattern) of the files of a table, for a stream: it may be one file or a folder of files."""
    one = table(spark, folder, name).inputFiles()[0].rpartition("/")[2] == f"{name}.parquet"
    return (folder, f"{name}.parquet") if one else (f"{folder}/{name}.parquet", "*.parquet")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One document per line; missing keys get their defaults, malformed lines are left out."""
    raw = spark.read.schema(JSONL + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    fill = {"celex": "unknown", "url": "", "language": ""}
    rows = raw.where(F.col("_bad").isNull()).drop("_bad")
    return rows.withColumns(
        {c: F.coalesce(c, F.lit(v)) for c, v in fill.items()}
        | {"paragraphs": F.coalesce("paragraphs", F.array().cast("array<string>")), "paragraph_nums": F.coalesce("paragraph_nums", F.array().cast("array<int>"))}
    )


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that :func:`lexgrain.sources.writers.publish` wrote."""
    from .writers import current

    return spark.read.parquet(f"{path}/{current(spark, path)}")


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("citing_celex", "cited_celex")


def gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).option("multiLine", True).json(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(key, content): one cached file per key; an empty file is a document that was looked for and not found."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return spark.read.option("wholetext", True).text(path).select(name.alias("key"), F.col("value").alias("content"))


def pending(wanted: DataFrame, cached: DataFrame, key: str = "key") -> DataFrame:
    """Keys without a cached file, empty files included among the cached."""
    return wanted.join(cached.select(key), key, "left_anti")


def prefer(first: DataFrame, second: DataFrame, key: str = "key") -> DataFrame:
    """(key, content) of the first source, of the second where the first is missing or empty; empty if both are."""
    both = first.select(key, F.nullif("content", F.lit("")).alias("_a")).join(second.select(key, F.nullif("content", F.lit("")).alias("_b")), key, "full")
    return both.select(key, F.coalesce("_a", "_b", F.lit("")).alias("content"))
