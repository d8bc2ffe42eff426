from pyspark.sql import functions as F

from lexgrain import file_queries as q
from lexgrain.operators import reports

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tasks(df):
    """Tasks that the scan of a small table takes: one a file, by the cost of opening one."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def test_buckets_join_and_group_without_an_exchange_and_are_pruned(spark):
    mentions, decisions = q.by_bucket(spark, FOLDER)
    both = mentions.join(decisions.hint("merge"), "celex").groupBy("celex").count()
    assert "SortMergeJoin" in plan(both) and "Exchange" not in plan(both)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(mentions.inputFiles()) == n
    key = mentions.first().celex
    one = mentions.where(F.col("celex") == key)
    assert tasks(one) == 1 and tasks(mentions.where("source = 'text'")) == n


def test_sketches_are_merged_within_their_error(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 50_000).cast("string").alias("v"), F.when(F.col("id") < 0, 1).alias("none"))
    kept = [reports.sketches(rows.where(c), ["k"], "v", "none") for c in ("id < 90000", "id >= 80000")]  # both know the rows between
    found = reports.merged_sketches(kept[0].unionByName(kept[1]), ["k"], "v", "none").collect()
    assert len(found) == 3 and all(abs(r.v - 50_000) < 0.04 * 50_000 and r.none == 0 for r in found)
    assert sum(r.n_rows for r in found) == 210_000
    assert reports.merged_sketches(kept[0].limit(0), ["k"], "v").collect() == []
