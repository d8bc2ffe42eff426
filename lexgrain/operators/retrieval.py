"""Hybrid retrieval for batches of questions: vector arm, keyword arm, facets and fusion.

A question is a row (qid, ...); a batch of checked size is broadcast and the corpus is scanned once. Every ranking
breaks ties explicitly.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vector_search

# RRF constant, candidates per arm, rerank pool, results, fusion weights.
RRF_K, PER_ARM, POOL, FINAL = 60, 40, 50, 8
VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3


def facet(equal: dict[str, list] | None = None, overlap: dict[str, list] | None = None, between: dict[str, tuple] | None = None) -> Column | None:
    """The conjunction of the facets that are set; null values fail a set facet. None where none is set."""
    parts: list[Column] = []
    parts += [F.col(c).isin(v) for c, v in (equal or {}).items() if v]
    parts += [F.arrays_overlap(F.col(c), F.array(*map(F.lit, v))) for c, v in (overlap or {}).items() if v]
    parts += [F.col(c).between(*v) for c, v in (between or {}).items() if v]
    return reduce(and_, parts) if parts else None


def with_facets(corpus: DataFrame, decisions: DataFrame | None, on: str, condition: Column | None) -> DataFrame:
    """``corpus`` filtered by facets of ``decisions``; the join is only made if a facet is set."""
    return corpus if condition is None else corpus.join(decisions.where(condition).select(on).distinct(), on, "left_semi")


def ranked(scored: DataFrame, by: str, *order: Column, name: str = "rank", top: int | None = None) -> DataFrame:
    """``scored`` with its rank from 1 per ``by``; ``top`` keeps the first ones."""
    out = scored.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out.where(F.col(name) <= top) if top else out


def vector_arm(corpus: DataFrame, questions: DataFrame, k: int = PER_ARM, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k nearest of corpus (id, embedding) for questions (qid, query_vector), exact.

    Vectors without a score (null, zero, of another dimension, with null or non-finite components) neither ask nor answer.
    """
    return vector_search.nearest(corpus, questions, k, metric, exclude_self)


def index_arm(corpus: DataFrame, questions: DataFrame, k: int = PER_ARM) -> DataFrame:
    """The vector arm by cosine on lists of nearest centroids: approximate, with measured recall; scores are exact."""
    return vector_search.by_lists(corpus, questions, k)


def keyword_arm(scored: DataFrame, k: int = PER_ARM) -> DataFrame:
    """(qid, id, score, rank) from full-text scores (qid, id, score)."""
    return ranked(scored, "qid", F.col("score").desc_nulls_last(), F.col("id"), top=k)


def merge_arms(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Full-outer merge by (qid, id) with both ranks and scores and where a candidate came from."""
    v = vector.select("qid", "id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    k = keyword.select("qid", "id", F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    source = F.when(F.col("vector_rank").isNotNull() & F.col("keyword_rank").isNotNull(), "both").when(F.col("vector_rank").isNotNull(), "vector").otherwise("keyword")
    out = v.join(k, ["qid", "id"], "full").withColumn("source", source)
    return out.withColumns({"vector_score": F.coalesce("vector_score", F.lit(0.0)), "keyword_score": F.coalesce("keyword_score", F.lit(0.0))})


def reciprocal(rank: str, k: int = RRF_K) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))


def fuse_rrf(merged: DataFrame, pool: int = POOL, k: int = RRF_K, *before: Column) -> DataFrame:
    """Reciprocal rank fusion; ties go to the vector rank, then the keyword rank. ``before`` sorts ahead of the score."""
    scored = merged.withColumn("hybrid_score", reciprocal("vector_rank", k) + reciprocal("keyword_rank", k))
    order = (*before, F.col("hybrid_score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last(), F.col("id"))
    return ranked(scored, "qid", *order, name="pool_rank", top=pool)


def fuse_weighted(merged: DataFrame, top: int = 15, wv: float = VECTOR_WEIGHT, wk: float = KEYWORD_WEIGHT) -> DataFrame:
    scored = merged.withColumn("hybrid_score", F.lit(wv) * F.col("vector_score") + F.lit(wk) * F.col("keyword_score"))
    return ranked(scored, "qid", F.col("hybrid_score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last(), F.col("id"), name="pool_rank", top=top)


def fuse_queries(fused: DataFrame, variant_of: DataFrame, top: int = POOL) -> DataFrame:
    """Scores of the variants (qid -> question) of a question summed by id, to 12 places: sums depend on their order."""
    summed = fused.join(variant_of, "qid").groupBy("question", "id").agg(F.round(F.sum("hybrid_score"), 12).alias("hybrid_score"))
    return ranked(summed, "question", F.col("hybrid_score").desc(), F.col("id"), name="pool_rank", top=top)


def candidates_json(pool: DataFrame, *fields: str, text: str = "text", most: int = 2000, rank: str = "pool_rank") -> DataFrame:
    """(qid, candidates): the pool as a JSON array of objects in its order: id (place), ``fields``, and ``most`` characters of text.

    A reranking service takes that much of a text; null fields are left out.
    """
    one = F.struct(F.col(rank).alias("id"), *[F.col(f) for f in fields], F.substring(text, 1, most).alias("text"))
    gathered = pool.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("_rows"))
    return gathered.select("qid", F.to_json("_rows").alias("candidates"))


def answer_prompt(context: DataFrame, questions: DataFrame, template: str) -> DataFrame:
    """(qid, prompt): ``template`` with {sources}, {question} and {conversation} filled in from context (qid, context) and
    questions (qid, question, conversation). A question without sources or conversation gets empty ones."""
    both = questions.join(context, "qid", "left")
    fill = {"{sources}": "context", "{question}": "question", "{conversation}": "conversation"}
    parts = [F.coalesce(F.col(fill[p]), F.lit("")) if p in fill else F.lit(p) for p in re.split(r"(\{sources\}|\{question\}|\{conversation\})", template) if p]
    return both.select("qid", F.concat(*parts).alias("prompt"))


def rerank(pool: DataFrame, scores: DataFrame, authority: DataFrame | None = None, final: int = FINAL, fallback: str = "pool") -> DataFrame:
    """Injected scores (qid, position, score[, reason]) joined to the pool by position; missing ones count 0.

    Order: score, authority (0 if unknown), hybrid score, pool order. A question without any score keeps its pool order; with
    ``fallback="authority"`` (as evaluation runs do it) it is ordered like one whose scores are all 0.
    """
    s = scores.select("qid", F.col("position").alias("pool_rank"), F.col("score").cast("double").alias("rerank_score"), *([F.col("reason")] if "reason" in scores.columns else [F.lit(None).cast("string").alias("reason")]))
    out = pool.join(s.dropDuplicates(["qid", "pool_rank"]), ["qid", "pool_rank"], "left")
    has = F.max(F.col("rerank_score").isNotNull()).over(Window.partitionBy("qid"))
    out = out.withColumn("has_scores", has)
    out = out.withColumns(
        {
            "reason": F.when(~F.col("has_scores"), "Fallback to hybrid order").when(F.col("rerank_score").isNull(), "No score returned").otherwise(F.col("reason")),
            "rerank_score": F.coalesce("rerank_score", F.lit(0.0)),
        }
    )
    if authority is None:
        out = out.withColumn("authority", F.lit(0.0))
    else:
        out = out.join(authority.select("id", F.col("authority").cast("double")), "id", "left").withColumn("authority", F.coalesce("authority", F.lit(0.0)))
    used = lambda c: F.when(F.col("has_scores") | F.lit(fallback == "authority"), F.col(c)).otherwise(F.lit(0.0))
    order = (used("rerank_score").desc(), used("authority").desc(), used("hybrid_score").desc(), F.col("pool_rank"))
    return ranked(out, "qid", *order, name="final_rank", top=final).drop("has_scores")


def context_blocks(ranked_rows: DataFrame, *fields: tuple[str, str], rank: str = "final_rank") -> DataFrame:
    """(qid, context): numbered blocks of labelled fields in rank order, separated by empty lines."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for label, c in fields]
    block = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("]\n"), F.concat_ws("\n", *lines))
    gathered = ranked_rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("bs"))
    return gathered.select("qid", F.array_join(F.transform("bs", lambda b: b["b"]), "\n\n").alias("context"))


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """(conv_id, context): role: text of the last n turns of each conversation, oldest first."""
    last = messages.withColumn("_back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), F.col("role"), F.col("text")))).where(F.col("_back") <= n)
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    return last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("o"), line.alias("l")))).alias("ls")).select("conv_id", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("context"))


def parse_scores(raw: Column) -> Column:
    """array<struct<id,score,reason>> from a model's answer: the outermost [...] span; an empty array if it is not valid."""
    span = F.nullif(F.regexp_extract(raw, r"(?s)\[.*\]", 0), F.lit(""))
    return F.coalesce(F.from_json(span, "array<struct<id:int,score:double,reason:string>>"), F.array().cast("array<struct<id:int,score:double,reason:string>>"))
