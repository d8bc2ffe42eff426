import threading

import pytest

from lexgrain.plans.lineage import discard, stored, temporary


def readable(df):
    try:
        return df.sparkSession.read.parquet(*df.inputFiles()).count() >= 0
    except Exception:
        return False


def test_what_is_kept_stays_whatever_its_place(spark):
    with temporary() as keep:
        a = keep(stored(spark.range(3).toDF("x"), "a"))
        b = stored(spark.range(3).toDF("x"), "b")
        with temporary() as inner:
            c = inner(stored(spark.range(2).toDF("x"), "c"))
            d = stored(spark.range(2).toDF("x"), "d")
        assert readable(b) and readable(c) and not readable(d)
    assert readable(a) and not readable(b) and not readable(c)
    discard(a)
    assert not readable(a)


def test_scopes_end_with_an_error_too(spark):
    with pytest.raises(ValueError), temporary():
        a = stored(spark.range(3).toDF("x"), "a")
        raise ValueError
    assert not readable(a)


def test_other_threads_tables_are_theirs(spark):
    made, opened, done = [], threading.Event(), threading.Event()

    def other():
        opened.wait(60)
        made.append(stored(spark.range(5).toDF("x"), "other"))
        done.set()

    t = threading.Thread(target=other)
    t.start()
    with temporary():
        opened.set()
        assert done.wait(60)
        mine = stored(spark.range(5).toDF("x"), "mine")
    t.join()
    assert readable(made[0]) and not readable(mine)
    discard(made[0])
