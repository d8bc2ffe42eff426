"""Corpus pipeline: language ID, quality rules, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller may write it as Parquet and hand it to the next one.
All but the last return the columns of ``documents``. The language stage rejects documents without an identifiable language,
the quality stage those its rules reject, the Jaccard stage keeps exactly one row of each near-duplicate group (of its least doc_id;
rows are judged one by one, so repeated rows and rows that share an id are not lost), and the dedup stage takes repeated passages out of the texts (whole characters only) and drops documents that have none left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.llm import language_id, ngram_jaccard, packing, quality_rules, suffix_dedup
from lexgrain.llm.queries import bpe_vocabulary, table
from lexgrain.plans.lineage import discard, stored, temporary

#: Shortest repeated passage that is removed: about 35 words, so that any passage of over 50 words counts.
PASSAGE_BYTES = 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text has no letter, has no language of half the probability, or is far from its language's n-grams."""
    return language_id.reject(docs, language_id.fit(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the decision list learned from ``labels``."""
    featured = stored(quality_rules.with_features(docs), "features")
    rules = quality_rules.fit(featured.select("__row.doc_id", *quality_rules.COUNTS), table(spark, sf_dir, "labels"))
    return quality_rules.kept_rows(featured, rules)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at a similarity of 0.8 of five-word shingles."""
    return ngram_jaccard.one_per_group(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every passage of PASSAGE_BYTES that also starts elsewhere out of the texts; n_chars follows."""
    return suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES).where(F.length("text") > 0).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1024."""
    return packing.pack(docs, bpe_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard", join_near_duplicates),
    ("suffix_array_dedup", remove_repeats),
    ("best_fit_packing", pack_sequences),
]

#: Tokens, learned models and suffix order have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next stage."""
    docs = before = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with temporary() as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), name))
        if k:
            discard(before)
        before = docs
    return docs
