import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrain.operators import inverted_index as x
from lexgrain.plans.lineage import scratch

LETTERS = "a b c d e the of".split()


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(tree, ts):
    if isinstance(tree, x.Phrase):
        start = tree.parts[0]
        return any(t == start[1] and all(i + d - start[0] < len(ts) and ts[i + d - start[0]] == w for d, w in tree.parts) for i, t in enumerate(ts))
    if isinstance(tree, x.Not):
        return not brute(tree.part, ts)
    return (any if isinstance(tree, x.Any) else all)(brute(p, ts) for p in tree.parts)


def some_tree(rng, depth=3):
    kind = rng.choice(["word", "phrase", "gap"] if depth == 0 else ["word", "phrase", "gap", "not", "all", "any"])
    if kind == "word":
        return x.word(rng.choice(LETTERS))
    if kind == "phrase":
        return x.phrase(" ".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 3))))
    if kind == "gap":
        return x.phrase(f"{rng.choice('abc')} the {rng.choice('abc')}", frozenset({"the"}))
    if kind == "not":
        return x.Not(some_tree(rng, depth - 1))
    return (x.All if kind == "all" else x.Any)(tuple(some_tree(rng, depth - 1) for _ in range(rng.randint(1, 3))))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 12)))) for k in range(300)]
    rows += [(k, f"only the {'a ' * k}") for k in (300, 301, 302)] + [(400, None), (401, ""), (402, "..."), (5, "of of the same id"), (None, "a null id of b")]
    return rows


@pytest.fixture(scope="module")
def index(spark, texts):
    """Blocks of 8 documents, written in three parts."""
    path, whole = scratch(spark, "index-test"), x.BITS
    x.BITS = 3
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS ordinal", "2 AS block", "'x' AS lexeme").repartition(3)
    x.write(docs.where("doc_id % 3 = 0"), path)
    x.add(docs.where("doc_id % 3 = 1"), path)
    x.add(docs.where("doc_id % 3 = 2 OR doc_id IS NULL"), path)
    yield x.read(spark, path)
    x.BITS = whole


def ids(rows):
    return sorted((r.id is None, r.id or 0) for r in rows)


def test_every_occurrence_is_stored(index, texts):
    got = sorted((r.id is None, r.id or 0, r.lexeme, r.pos) for r in x.occurrences(index, LETTERS).collect())
    assert got == sorted((d is None, d or 0, w, k) for d, t in texts for k, w in enumerate(words(t), 1) if w in LETTERS)
    assert index.documents.count() == len(texts) == index.documents.select("ordinal").distinct().count()


def test_nested_trees_against_brute_force(index, texts):
    rng = random.Random(9)
    for _ in range(25):
        tree = some_tree(rng)
        want = sorted((d is None, d or 0) for d, t in texts if brute(tree, words(t)))
        assert ids(x.matching(index, tree).collect()) == want, tree
    assert x.matching(index, None).collect() == []


def test_web_queries(index, texts):
    stop = frozenset({"the", "of"})
    for query, want in {
        '"a the b" -c': lambda t: re.search(r"\ba \w+ b\b", t) and "c" not in t.split(),
        "-a or b": lambda t: "a" not in t.split() or "b" in t.split(),
        "the": None,
        '"the a" of': lambda t: "a" in t.split(),
    }.items():
        got = ids(x.matching(index, x.web_tree(query, stop)).collect())
        assert got == ([] if want is None else sorted((d is None, d or 0) for d, t in texts if want(" ".join(words(t))))), query


@pytest.mark.parametrize("k", [1, 3, 40, 1000])
def test_top_by_term(index, texts, k):
    asked = {1: "a", 2: "of", 3: "nowhere", 4: "a", 5: "only"}
    got: dict = {}
    for r in sorted(x.top_by_term(index, asked, k).collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append((r.id, round(r.score * 10)))
    want = {}
    for q, w in asked.items():
        counted = sorted(((-words(t).count(w), d is not None, d or 0, d) for d, t in texts if w in words(t)))[:k]
        if counted:
            want[q] = [(d, -n) for n, _, _, d in counted]
    assert got == want


def test_only_rows_of_the_asked_lexemes_are_read(spark, texts):
    path = scratch(spark, "index-test")
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 5000}" for j in range(40))) for k in range(4000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small: it would be one file
    try:
        x.write(docs, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = x.read(spark, path)
    plan = x.matching(index, x.phrase("w17 w34"))._jdf.queryExecution().executedPlan().toString()
    assert "In(lexeme, [w17,w34])" in plan or "In(lexeme, [w34,w17])" in plan
    # files are ranges of lexemes: one of several holds a lexeme
    spread = index.postings.where("lexeme = 'w17'").select(F.input_file_name()).distinct().count()
    assert spread == 1 < len(index.postings.inputFiles())
    top = x.top_by_term(index, {1: "w17"}, 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lexeme,w17)" in top and "GreaterThanOrEqual(most," in top


def test_empty_tables(spark):
    path = scratch(spark, "index-test")
    none = spark.createDataFrame([], "doc_id long, text string")
    x.write(none, path)
    x.add(none, path)
    index = x.read(spark, path)
    assert x.matching(index, x.Not(x.word("a"))).collect() == [] and x.top_by_term(index, {1: "a"}, 3).collect() == []


def shuffled_rows(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_lists_of_a_block_are_shuffled_and_not_its_tokens(spark, monkeypatch):
    monkeypatch.setattr(x, "BITS", 10)
    docs = spark.range(0, 3000, 1, 2).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the of a "), 50).alias("text"))
    path, before = scratch(spark, "inverted"), shuffled_rows(spark)
    x.write(docs, path)
    assert shuffled_rows(spark) - before <= 45_000  # of 450,000 tokens; other tests' stages may be counted late
    lists = x.read(spark, path).postings
    assert lists.count() == lists.select("lexeme", "block").distinct().count() == 12  # two blocks a part
    assert lists.agg(F.sum("n"), F.sum(F.aggregate("counts", F.lit(0), lambda a, c: a + c)), F.max("most")).first()[:] == (9000, 450_000, 50)


def test_postings_of_documents_in_two_blocks_with_a_left_out_token():
    ts = [["a", None, "b", "a"], [], ["b"]]
    names, cols = x._postings_of(pa.table({"ordinal": [1023, 1024, 1025], "id": ["p", "q", "r"], "ts": pa.array(ts, pa.list_(pa.string()))}), 10)
    got = pa.table(dict(zip(names, cols, strict=True))).to_pylist()
    assert sorted((r["lexeme"], r["block"], r["n"], r["most"], r["places"], r["counts"], r["positions"]) for r in got) == [
        ("a", 0, 1, 2, [1023], [2], [[1, 4]]), ("b", 0, 1, 1, [1023], [1], [[3]]), ("b", 1, 1, 1, [1], [1], [[1]]),
    ]
