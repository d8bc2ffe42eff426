import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrain.functions import vectors
from lexgrain.operators import vector_search as s

SCHEMA = "id long, embedding array<float>"


def table(spark, x, first=0):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(first, first + len(x)), "embedding": list(x)}), SCHEMA)


def plain(corpus, questions, k, metric):
    """Every pair scored by column functions."""
    f = vectors.cosine if metric == "cosine" else vectors.l2
    pairs = corpus.crossJoin(questions).select("qid", "id", f(F.col("embedding"), F.col("query_vector")).alias("score"))
    out: dict = {}
    for r in pairs.where("score is not null").collect():
        out.setdefault(r.qid, []).append((-r.score if metric == "cosine" else r.score, r.id))
    return {q: [(i, c) for c, i in sorted(v)[:k]] for q, v in out.items()}


def got(rows, metric):
    out: dict = {}
    for r in sorted(rows, key=lambda r: r.rank):
        out.setdefault(r.qid, []).append((r.id, -r.score if metric == "cosine" else r.score))
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_the_same_as_scoring_every_pair(spark, metric):
    """Several blocks, equal vectors across blocks, ties at the k-th place: ids and scores to the last bit."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((5000, 64)).astype(np.float32)
    x[4000:4400] = x[0]
    corpus = table(spark, x).repartition(3)
    questions = corpus.where("id < 12").select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    assert s.packed(corpus, "id", "embedding").count() > 2
    assert got(s.nearest(corpus, questions, 10, metric).collect(), metric) == plain(corpus, questions, 10, metric)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_vectors_without_a_score(spark, metric):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, float("nan")]), (8, [float("inf"), 0.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (1, [1.0, 0.0])]
    corpus = spark.createDataFrame(rows, SCHEMA)
    questions = corpus.select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    found = got(s.nearest(corpus, questions.where("qid in (2, 3, 4, 6, 7, 8, 9)"), 3, metric).collect(), metric)
    assert set(found) == {2, 9} and [i for i, _ in found[9]] == [9]
    assert [i for i, _ in found[2]] == ([1, 1, 2] if metric == "cosine" else [2, 1, 1])
    zero = s.nearest(corpus, questions.where("qid = 5"), 9, metric).collect()
    assert len(zero) == (0 if metric == "cosine" else 5)
    apart = s.nearest(corpus, questions.where("qid = 2"), 3, metric, exclude_self=True).collect()
    assert 2 not in {r.id for r in apart} and len(apart) == 3
    empty = corpus.limit(0)
    assert s.nearest(empty, questions, 3, metric).count() == 0 and s.nearest(corpus, questions.limit(0), 3, metric).count() == 0


def test_questions_beyond_the_broadcast_and_other_keys(spark, monkeypatch):
    x = np.random.default_rng(2).standard_normal((300, 8)).astype(np.float32)
    corpus = table(spark, x).withColumn("id", F.concat(F.lit("v"), "id")).withColumn("score", F.lit("clash"))
    questions = corpus.where("id like 'v1%'").select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    want = got(s.nearest(corpus, questions, 5, exclude_self=True).collect(), "cosine")
    monkeypatch.setattr(s, "MOST_BYTES", 0)
    assert got(s.nearest(corpus, questions, 5, exclude_self=True).collect(), "cosine") == want
    assert all(q not in {i for i, _ in v} and len(v) == 5 for q, v in want.items()) and len(want) == 111


def recall(spark, x, k=10):
    corpus = table(spark, x)
    questions = corpus.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    exact = {(r.qid, r.id): r.score for r in s.nearest(corpus, questions, k).collect()}
    found = {(r.qid, r.id): r.score for r in s.by_lists(corpus, questions, k).collect()}
    assert all(exact[p] == c for p, c in found.items() if p in exact)
    return len(exact.keys() & found.keys()) / len(exact)


def test_recall_of_many_lists_beyond_the_sample(spark, monkeypatch):
    """12,000 vectors of groups and without any, a sample of 2,000, 46 lists, a third of all rows in one group dealt into slots."""
    monkeypatch.setattr(s, "SAMPLE", 2000)
    monkeypatch.setattr(s, "PER_SLOT", 500)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 32))
    centres[:20] = centres[0]
    x = centres[rng.integers(0, 60, 9000)] + 0.4 * rng.standard_normal((9000, 32))
    x = np.concatenate([x, rng.standard_normal((3000, 32))]).astype(np.float32)
    lists = s.fit_lists(x[rng.choice(12000, 2000, replace=False)].astype(float), 12000, 10)
    assert len(lists.centroids) == 46 and lists.probes < 40 and max(lists.slots) > 1
    assert recall(spark, x) >= 0.9


def test_lists_of_few_vectors_and_of_other_dimensions(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.5, 0.0])]
    corpus = spark.createDataFrame(rows, SCHEMA)
    questions = corpus.select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    found = got(s.by_lists(corpus, questions, 2).collect(), "cosine")
    assert {q: [i for i, _ in v] for q, v in found.items()} == {1: [1, 2], 2: [2, 1], 5: [5, 6], 6: [6, 5]}
    assert s.by_lists(corpus.limit(0), questions, 2).count() == 0


def test_first_ranks_break_ties_by_the_least_id():
    one = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("qid", "id", "score"), r)) for r in rows], schema=pa.schema([("qid", pa.string()), ("id", pa.int64()), ("score", pa.float64())]))
    found = [one(("a", 9, 0.5), ("b", 1, 0.1), ("a", 3, 0.5)), one(("a", 4, 0.5), ("a", 8, 0.7), ("b", 2, 0.2), (None, 7, 0.0))]
    rows = {(r["qid"], r["id"]) for r in s.first_ranks(found, 2, "cosine").to_pylist()}
    assert rows == {("a", 8), ("a", 3), ("b", 1), ("b", 2), (None, 7)}
    assert {r["id"] for r in s.first_ranks(found, 1, "l2").to_pylist()} == {3, 1, 7}


def test_pairs_of_blocks_reach_a_task_a_few_at_a_time(spark):
    """A batch of up to 10,000 pairs would hold 20 GB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    blocks = spark.range(64, numPartitions=1).select(F.lit(0).alias("qids"), F.repeat(F.lit("x"), s.BLOCK_BYTES).cast("binary").alias("x"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    s.nearest(table(spark, np.ones((3, 2), dtype=np.float32)), table(spark, np.ones((1, 2), dtype=np.float32)).toDF("qid", "query_vector"), 1)
    assert blocks.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= 36 << 20
