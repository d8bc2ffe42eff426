import random

import corpus_pipeline
from lexgrain.plans.lineage import stored

from . import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    r = random.Random(3)
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars between 600 and 4000").orderBy("doc_id").limit(60).collect()
    rows = [tuple(x) for x in sample]
    good = [x for x in rows if not set("|#*") & set(x[1]) and "!!" not in x[1]][:6]
    passage = " ".join(f"{r.choice('abcdefgh')}{r.randint(0, 9999)}word" for _ in range(60))
    rows += [(7000 + k, f"{x[1]}\n{passage}\n{x[1][::-1]}", x[2], "p", 1) for k, x in enumerate(good)]
    rows += [(8000, good[0][1] + " extra", good[0][2], "n", 1), (8001, None, None, None, None), (8002, "123 456", "en", "x", 7), (8003, "", "en", "x", 0)]
    return spark.createDataFrame(rows, COLUMNS), passage


def test_stages_in_turn(spark):
    docs, passage = corpus(spark)
    folder = "/root/testdata/sf0.01"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "ngram_jaccard", "suffix_array_dedup", "best_fit_packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder), name)
        if name != names[-1]:
            assert out.columns == docs.columns
        kept[name], docs = out, out
    ids = {n: {r.doc_id for r in kept[n].collect()} for n in names}
    assert not ids["language_id"] & {8001, 8002, 8003} and 8000 in ids["language_id"]
    assert ids["quality_rules"] <= ids["language_id"]
    rows = [(r.doc_id, r.text) for r in kept["quality_rules"].collect()]
    assert ids["ngram_jaccard"] == {i for i, _, c in brute.jaccard_components(rows) if i == c}
    assert not [r for r in kept["suffix_array_dedup"].collect() if passage[5:-5] in r.text or r.n_chars != len(r.text)]
    assert ids["best_fit_packing"] == ids["suffix_array_dedup"]


def test_repeated_rows_and_ids_and_other_columns(spark):
    """One row of each group stays: of equal rows one, of an id with several texts each; other columns come along."""
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.01"
    clean = [tuple(x) for x in spark.read.parquet(f"{folder}/documents.parquet").where("n_chars between 900 and 3000 and lang = 'en'").orderBy("doc_id").collect() if not set("|#*!&$%") & set(x.text)]
    texts = sorted({x[1] for x in clean}, key=lambda t: next(x[0] for x in clean if x[1] == t))[:12]
    alone = [i for i, c in enumerate(c for _, _, c in brute.jaccard_components(list(enumerate(texts)))) if i == c]
    first, second, third = (texts[i] for i in alone[:3])
    rows = [(1, first, "en", "s", 1)] * 3 + [(2, second, "en", "s", 1), (2, third, "en", "s", 1), (2, second + " more words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("cls", F.lit("c")).withColumn("n", F.lit(7)).withColumn("key", F.col("doc_id"))
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stored(stage(spark, docs, folder), "docs")
        assert docs.columns == names
    got = sorted((x.doc_id, x.text, x.cls, x.n) for x in docs.collect())
    assert [(i, t) for i, t, _, _ in got if t not in (second, second + " more words")] == sorted([(1, first), (2, third)])
    assert len(got) == 3 and all(c == "c" and n == 7 for _, _, c, n in got)
    out = corpus_pipeline.remove_repeats(spark, docs, folder)
    assert out.columns == names and {x.doc_id for x in out.collect()} == {1, 2}


def test_run_leaves_only_what_its_result_reads(spark):
    import os

    from lexgrain.plans.lineage import shared_dir

    where = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(where))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() and {x.partition("-")[0] for x in set(os.listdir(where)) - before if os.listdir(f"{where}/{x}") and not x.count("-") == 4} <= {"suffix_array_dedup", "pieces"}


def test_empty_documents(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0
