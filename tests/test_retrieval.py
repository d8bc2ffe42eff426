from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrain.operators import evaluation as e
from lexgrain.operators import retrieval as r

ARM = "qid int, id string, score double, rank int"


def test_rrf_ties_go_to_the_vector_arm(spark):
    v = spark.createDataFrame([(1, "A", 0.9, 1), (1, "C", 0.8, 2)], ARM)
    k = spark.createDataFrame([(1, "B", 0.5, 1), (1, "C", 0.4, 2)], ARM)
    rows = r.fuse_rrf(r.merge_arms(v, k)).orderBy("pool_rank").collect()
    assert [(x.id, x.source) for x in rows] == [("C", "both"), ("A", "vector"), ("B", "keyword")]


def test_rerank_missing_scores_and_fallback(spark):
    pool = spark.createDataFrame([(1, "a", 0.3, 1), (1, "b", 0.2, 2), (1, "c", 0.1, 3), (2, "d", 0.1, 1), (2, "e", 0.1, 2)], "qid int, id string, hybrid_score double, pool_rank int")
    scores = spark.createDataFrame([(1, 3, 9.0)], "qid int, position int, score double")
    auth = spark.createDataFrame([("b", 1.0), ("e", 5.0)], "id string, authority double")
    rows = r.rerank(pool, scores, auth).orderBy("qid", "final_rank").collect()
    assert [x.id for x in rows] == ["c", "b", "a", "d", "e"]
    assert rows[1].reason == "No score returned" and rows[3].reason == "Fallback to hybrid order"


def test_parse_scores(spark):
    raw = ['```json\n[{"id": 1, "score": 7.5, "reason": "x"}]\n```', "no json", "[]", '[{"id": 2}]', None]
    rows = spark.createDataFrame([(x,) for x in raw], "t string").select(r.parse_scores(F.col("t")).alias("s")).collect()
    assert [[(s.id, s.score) for s in x.s] for x in rows] == [[(1, 7.5)], [], [], [(2, None)], []]


def test_facets_without_any_make_no_join(spark):
    df = spark.createDataFrame([(1,)], "id int")
    assert r.with_facets(df, None, "id", r.facet()) is df
    d = spark.createDataFrame([(1, None, ["x"]), (2, "en", ["x", "y"])], "id int, lang string, tags array<string>")
    got = r.with_facets(spark.createDataFrame([(1,), (2,)], "id int"), d, "id", r.facet(equal={"lang": ["en"]}, overlap={"tags": ["y"]}))
    assert [x.id for x in got.collect()] == [2]


def test_ndcg_ideal_is_what_was_found(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "z", 2), (2, "z", 1)], "qid int, case_id string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "qid int, case_id string")
    rows = {x.qid: (round(x.recall, 6), x.mrr, x.ndcg) for x in e.score_cases(ranking, gold).collect()}
    assert rows == {1: (0.333333, 1.0, 1.0), 2: (0.0, 0.0, 0.0)}


def test_paragraph_recall_of_questions_without_gold(spark):
    got = spark.createDataFrame([(1, "a", 5)], "qid int, case_id string, paragraph int")
    q = spark.createDataFrame([(1,), (2,)], "qid int")
    assert {x.qid: x.paragraph_recall for x in e.paragraph_recall(got, got, q).collect()} == {1: 1.0, 2: 0.0}
    assert e.paragraph_recall(got, got, q, skip_empty=True).count() == 1


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.integers(1, 30)), min_size=1, max_size=20))
def test_scores_stay_within_bounds(spark, rows):
    ranking = e.case_ranking(spark.createDataFrame(rows, "qid int, case_id int, rank int"))
    gold = spark.createDataFrame([(q, c) for q in range(4) for c in (1, 2)], "qid int, case_id int")
    for x in e.score_cases(ranking, gold).collect():
        assert 0 <= x.recall <= 1 and 0 <= x.mrr <= 1 and 0 <= x.ndcg <= 1 + 1e-9
