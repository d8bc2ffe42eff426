import datetime as dt

from pyspark.sql import functions as F

from lexgrain.plans.lineage import scratch
from lexgrain.streaming import stateful

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, at timestamp, v string"


def put(spark, folder, rows):
    """One more file: rows of (id, hours, v)."""
    spark.createDataFrame([(i, START + dt.timedelta(hours=h), v) for i, h, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(query):
    query.awaitTermination()
    return query.recentProgress


def held(progress):
    return sum(s["numRowsTotal"] for s in progress[-1]["stateOperators"])


def test_deduplication_survives_restarts_and_forgets(spark):
    base = scratch(spark, "stateful")
    source, out, state = f"{base}/in", f"{base}/out", f"{base}/state"
    go = lambda: run(stateful.append(stateful.deduplicated(stateful.files(spark, source, SCHEMA), "at", "10 hours", "id"), out, state))
    put(spark, source, [(1, 0, "a"), (1, 0, "a"), (2, 1, "b"), (None, 1, "n"), (None, 2, "n")])
    go()
    assert sorted(r.id or 0 for r in spark.read.parquet(out).collect()) == [0, 1, 2]
    go()  # nothing new
    put(spark, source, [(2, 2, "again"), (3, 3, "c")])
    go()
    assert sorted(r.id or 0 for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    put(spark, source, [(k, 100 + k, "d") for k in range(10, 15)])
    go()
    put(spark, source, [(20, 1, "too late"), (21, 120, "e")])
    last = go()
    assert sorted(r.id or 0 for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 10, 11, 12, 13, 14, 21]
    assert 0 < held(last) < 8  # the first keys are forgotten


def test_feedback_meets_its_log_in_any_order_and_state_goes(spark):
    base = scratch(spark, "stateful")
    log, back, out, state = (f"{base}/{x}" for x in ("log", "back", "out", "state"))

    def go():
        one = stateful.files(spark, log, SCHEMA).select("id", F.col("at").alias("asked"))
        two = stateful.files(spark, back, SCHEMA).select("id", F.col("at").alias("given"), "v")
        return run(stateful.append(stateful.with_feedback(one, two, "id", "asked", "given", "5 hours", "10 hours"), out, state))

    put(spark, log, [(1, 0, ""), (2, 1, ""), (3, 2, "")])
    put(spark, back, [(1, 1, "good"), (1, 2, "bad"), (9, 3, "early"), (3, 8, "after more than five hours")])
    go()
    put(spark, log, [(9, 2, "comes after its feedback")])
    put(spark, back, [(2, 5, "good")])
    go()
    got = lambda: sorted((r.id, r.v) for r in spark.read.parquet(out).collect())
    assert got() == [(1, "bad"), (1, "good"), (2, "good"), (9, "early")]
    put(spark, log, [(k, 200, "") for k in range(50, 53)])
    put(spark, back, [(50, 201, "good")])
    go()
    put(spark, log, [(4, 3, "too late")])
    put(spark, back, [(4, 4, "too late")])
    last = go()
    assert got() == [(1, "bad"), (1, "good"), (2, "good"), (9, "early"), (50, "good")]
    assert held(last) <= 4  # only what is near the newest times


def test_windows_are_given_once_when_closed(spark):
    base = scratch(spark, "stateful")
    source, out, state = f"{base}/in", f"{base}/out", f"{base}/state"
    go = lambda: run(stateful.append(stateful.closed_windows(stateful.files(spark, source, SCHEMA), "at", "v", "1 day", "12 hours"), out, state))
    put(spark, source, [(1, 1, "a"), (2, 30, "a")])
    go()
    assert spark.read.parquet(out).count() == 0  # the first day may still change
    put(spark, source, [(3, 20, "a"), (4, 40, "b")])
    go()
    put(spark, source, [(5, 2, "too late"), (6, 90, "a")])
    last = go()
    assert sorted((r.window_start.day, r.v, r.n) for r in spark.read.parquet(out).collect()) == [(1, "a", 2), (2, "a", 1), (2, "b", 1)]
    assert held(last) == 1
