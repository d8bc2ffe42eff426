"""Text functions with Unicode white space: the JVM's own trim and \\s know only ASCII."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks cut from the ends of party names.
PARTY_TRIM = " ,.‘’'"


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_tags(html: Column) -> Column:
    """Tags to spaces, white space collapsed and trimmed; character references stay as they are."""
    return squeeze(F.regexp_replace(html, r"<[^>]+>", " "))


def parties(line: Column) -> Column:
    """Names on both sides of `` v ``; empty unless there are two at least."""
    sides = F.split(line, r"(?U)\s+v\.?\s+")
    named = F.filter(F.transform(sides, lambda p: F.btrim(p, F.lit(PARTY_TRIM))), lambda p: p != "")
    return F.when(F.size(sides) >= 2, named).otherwise(F.array().cast("array<string>"))


def title_fields(raw: Column) -> tuple[Column, Column]:
    """(title, parties) of a title whose fields are separated by #; the second field names the parties."""
    fields = F.filter(F.transform(F.split(raw, "#"), strip), lambda f: f != "")
    line = F.regexp_replace(F.try_element_at(fields, F.lit(2)), r"\.$", "")
    return strip(F.replace(raw, F.lit("#"), F.lit(" "))), F.coalesce(parties(line), F.array().cast("array<string>"))


def title_html(html: Column) -> tuple[Column, Column]:
    """(title, parties) of a page whose title paragraph has the id title; parties stand in the sentence after the preamble."""
    title = strip_tags(F.nullif(F.regexp_extract(html, r'(?s)<p[^>]*id="title"[^>]*>(.*?)</p>', 1), F.lit("")))
    body = F.regexp_replace(title, r"^Judgment of the Court[^.]*\.(?U)\s*", "")
    first = F.element_at(F.split(body, r"(?U)\.\s", 2), 1)
    return title, F.coalesce(parties(first), F.array().cast("array<string>"))


def chunks(docs: DataFrame, key: str, text: str, separator: str, least: int, most: int | None = None) -> DataFrame:
    """(key, chunk_index, chunk_id, chunk): stripped parts of a text of ``least`` characters or more; the index counts all parts.

    ``most`` cuts a part before its length is judged. Null and empty texts have no chunks.
    """
    parts = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key), F.posexplode(F.split(text, separator)).alias("chunk_index", "chunk"))
    cut = strip(F.col("chunk"))
    cut = F.substring(cut, 1, most) if most else cut
    return parts.withColumn("chunk", cut).where(F.length("chunk") >= least).withColumn("chunk_id", F.concat_ws("_", F.col(key), F.lit("p"), F.col("chunk_index")))


def paragraphs(docs: DataFrame, least: int = 80, most: int = 6000) -> DataFrame:
    """(celex, id, paragraph_number, paragraph_index, text) from parallel arrays ``paragraphs`` and ``paragraph_nums``.

    Ids and indexes use the place in the array, so short paragraphs leave gaps; a number beyond the numbers' end is place + 1,
    a null within them stays null.
    """
    nums = F.coalesce("paragraph_nums", F.array().cast("array<int>"))
    each = docs.select(F.coalesce("celex", F.lit("unknown")).alias("celex"), nums.alias("nums"), F.posexplode("paragraphs").alias("paragraph_index", "raw"))
    text = F.substring(strip(F.coalesce("raw", F.lit(""))), 1, most)
    number = F.when(F.size("nums") > F.col("paragraph_index"), F.try_element_at("nums", F.col("paragraph_index") + 1)).otherwise(F.col("paragraph_index") + 1)
    return each.select("celex", F.concat_ws("_", "celex", F.lit("p"), "paragraph_index").alias("id"), number.alias("paragraph_number"), "paragraph_index", text.alias("text")).where(
        F.length("text") >= least
    )
