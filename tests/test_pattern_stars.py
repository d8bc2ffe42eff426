import random
from pathlib import Path

import pytest

from lexgrain import queries as q
from lexgrain.operators import patterns as p
from lexgrain.plans.lineage import shared_dir

from .test_patterns import T, brute

TRIPLES = "s string, p string, o string, lang string"


def some_graph(spark, rng):
    """Two tables by subject and triples beside them, with nulls."""
    cell = lambda: rng.choice(["a", "b", "c", "d", None])
    subjects = rng.sample("abcdef", 4)
    one = spark.createDataFrame([(s, cell(), cell()) for s in subjects], "s string, p string, q string")
    two = spark.createDataFrame([(s, cell()) for s in rng.sample("abcdef", 4)], "s string, r string")
    rest = spark.createDataFrame([(rng.choice("abcd"), "t", rng.choice("abcd"), rng.choice(["en", "fr", None])) for _ in range(8)], TRIPLES)
    return p.Graph((one, two), rest)


def test_patterns_over_tables_by_subject_against_brute_force(spark):
    rng = random.Random(7)
    for _ in range(10):
        g = some_graph(spark, rng)
        rows = [tuple(r) for r in g.triples().collect()]
        term = lambda of: rng.choice([rng.choice(of), "?x", "?y", "?z"])
        asked = [T(term("abcd"), rng.choice("pqrt") if rng.random() < 0.9 else "?x", term("abcd"), rng.choice([None, None, None, "en"])) for _ in range(rng.randint(1, 4))]
        if not all(t.variables() for t in asked):
            continue
        got = sorted(sorted((c, r[c]) for c in r.asDict()) for r in p.match(g, *asked).collect())
        assert got == brute(rows, asked), asked


def test_what_is_asked_of_one_subject_needs_no_join(spark):
    g = some_graph(spark, random.Random(1))
    plan = p.match(g, T("?x", "p", "?y"), T("?x", "q", "?z"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_many_entities_are_met_last_and_few_first_with_one_result(spark, monkeypatch, seed):
    rng = random.Random(seed)
    g = some_graph(spark, rng)
    entities = spark.createDataFrame([(x, k) for k, x in enumerate("abcda")], "x string, k int")
    for asked in ((T("?x", "p", "?y"), T("?y", "r", "?z")), (T("?z", "t", "?x"), T("?z", "q", "?w")), (T("?x", "q", "?x"),)):
        want = sorted(b for b in entities.collect() if any(dict(m).get("x") == b.x for m in brute([tuple(r) for r in g.triples().collect()], list(asked))))
        for most in (0, 100):
            monkeypatch.setattr(p, "MOST_ROWS", most)
            assert sorted(p.holds(entities, g, *asked).collect()) == want


@pytest.mark.parametrize("name", ["pattern_english_items", "pattern_manifestations"])
def test_no_triples_are_written(spark, monkeypatch, name):
    """Each query wrote the whole graph first, more than what it read."""
    monkeypatch.setattr(p, "store", lambda *x: pytest.fail("the graph is written"))
    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("*"))
    assert q.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    new = set(Path(shared_dir(spark).removeprefix("file:")).glob("*")) - before
    assert sum(f.stat().st_size for d in new for f in d.rglob("*.parquet")) < 10_000


def test_only_lines_of_repeated_keys_are_numbered(spark):
    line = [(1, 1, 5, 7, "N", "O", 20.0, 0.1), (1, 1, 5, 7, "N", "F", 20.0, 0.1), (1, 1, 5, 7, "N", "O", 20.0, 0.1), (2, 1, 5, 7, "R", "O", 1.0, 0.0), (None, 1, 5, 7, "R", "O", 1.0, 0.0)]
    df = spark.createDataFrame(line, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_discount double")
    got = q._told_apart(df)
    assert sorted((r.l_orderkey or 0, r.again, r.l_linestatus) for r in got.collect()) == [(0, 1, "O"), (1, 1, "F"), (1, 2, "O"), (1, 3, "O"), (2, 1, "O")]
    assert set(got.columns) == {*df.columns, "again"}
