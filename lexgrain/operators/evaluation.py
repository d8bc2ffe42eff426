"""Retrieval evaluation as window aggregations over rankings of all questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def case_ranking(paragraphs: DataFrame) -> DataFrame:
    """(qid, case_id, rank): each case at its first paragraph's place, ranks without gaps."""
    first = paragraphs.groupBy("qid", "case_id").agg(F.min("rank").alias("first"))
    return first.select("qid", "case_id", F.row_number().over(Window.partitionBy("qid").orderBy("first", "case_id")).alias("rank"))


def gold_positions(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, case_id, rank): the place of every gold entry, null where it was not retrieved."""
    return gold.select("qid", "case_id").join(ranking, ["qid", "case_id"], "left")


def score_cases(ranking: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(qid, recall, mrr, ndcg). Recall and nDCG look at the first k, MRR at the whole ranking.

    The ideal of nDCG is what was retrieved in its best order, not the number of gold cases.
    """
    at = gold_positions(ranking, gold)
    near = F.col("rank") <= k
    gain = F.when(near, F.lit(1.0) / F.log2(F.col("rank") + 1))
    scored = at.groupBy("qid").agg(
        F.count("*").alias("n_gold"), F.count_if(near).alias("found"), F.min("rank").alias("first"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"), F.countDistinct(F.when(near, F.col("case_id"))).alias("h")
    )
    ideal = F.aggregate(F.when(F.col("h") > 0, F.sequence(F.lit(1), F.col("h").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1))
    return scored.select(
        "qid", (F.col("found") / F.col("n_gold")).alias("recall"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.try_divide(F.col("dcg"), ideal), F.lit(0.0)).alias("ndcg")
    )


def paragraph_recall(retrieved: DataFrame, gold: DataFrame, questions: DataFrame, skip_empty: bool = False) -> DataFrame:
    """(qid, paragraph_recall): share of gold (qid, case_id, paragraph) pairs among the retrieved ones.

    A question without gold paragraphs scores 0, or is left out with ``skip_empty``.
    """
    keys = ["qid", "case_id", "paragraph"]
    wanted = gold.select(*keys).distinct()
    hit = wanted.join(retrieved.select(*keys).distinct(), keys, "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    size = wanted.groupBy("qid").agg(F.count("*").alias("n"))
    out = questions.select("qid").distinct().join(size, "qid", "inner" if skip_empty else "left").join(hit, "qid", "left")
    return out.select("qid", (F.coalesce("hits", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("paragraph_recall"))


def macro_average(scores: DataFrame, *columns: str, gaps: DataFrame | None = None) -> DataFrame:
    """Means over questions, those of ``gaps`` (qid) left out."""
    own = scores if gaps is None else scores.join(gaps.select("qid").distinct(), "qid", "left_anti")
    return own.agg(F.count("*").alias("n_questions"), *[F.avg(c).alias(c) for c in columns])


def compare(old: DataFrame, new: DataFrame, metric: str, flags: tuple[str, str, str] = ("WIN", "LOSS", "SAME")) -> DataFrame:
    """(qid, old, new, flag): the first of ``flags`` where new is better, the second where it is worse, else the third."""
    both = old.select("qid", F.col(metric).alias("old")).join(new.select("qid", F.col(metric).alias("new")), "qid")
    return both.withColumn("flag", F.when(F.col("new") > F.col("old"), flags[0]).when(F.col("new") < F.col("old"), flags[1]).otherwise(flags[2]))


def probe(paragraphs: DataFrame, case: DataFrame, top: int = 40) -> DataFrame:
    """(qid, first_rank, best, in_top): the first place of each question's case (qid, case_id), its three best paragraphs."""
    own = paragraphs.join(case, ["qid", "case_id"])
    return own.groupBy("qid").agg(
        F.min("rank").alias("first_rank"), F.slice(F.array_sort(F.collect_list(F.struct("rank", "paragraph"))), 1, 3).alias("best"), F.bool_or(F.col("rank") <= top).alias("in_top")
    )


def explode_gold(gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, paragraphs, gaps) from nested gold entries (id, expected array<struct<celex,name,paragraphs>>, corpus_gap)."""
    each = gold.select(F.col("id").alias("qid"), F.explode("expected").alias("e"))
    cases = each.select("qid", F.col("e.celex").alias("case_id"))
    paragraphs = each.select("qid", F.col("e.celex").alias("case_id"), F.explode("e.paragraphs").alias("paragraph"))
    return cases, paragraphs, gold.where(F.coalesce("corpus_gap", F.lit(False))).select(F.col("id").alias("qid"))
