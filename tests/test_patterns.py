import itertools
import random

from lexgrain import queries as q
from lexgrain.operators import patterns as p
from lexgrain.plans.lineage import scratch

T = p.Triple


def brute(rows, patterns):
    found = [{}]
    for t in patterns:
        out = []
        for b, (s, q, o, lang) in itertools.product(found, rows):
            own, ok = dict(b), t.lang is None or lang == t.lang
            for want, have in ((t.s, s), (t.p, q), (t.o, o)):
                ok = ok and (own.setdefault(want, have) == have if want.startswith("?") else want == have)
            if ok:
                out.append(own)
        found = out
    return sorted(sorted((k[1:], v) for k, v in b.items()) for b in found)


def some(rng, n=40):
    return [(rng.choice("abcd"), rng.choice("pqr"), rng.choice("abcd"), rng.choice(["en", "fr", None])) for _ in range(n)]


def test_patterns_against_brute_force(spark):
    rng = random.Random(2)
    for _ in range(12):
        rows = some(rng, 25)
        triples = spark.createDataFrame(rows, "s string, p string, o string, lang string")
        term = lambda of: rng.choice([rng.choice(of), "?x", "?y", "?z"])
        asked = [T(term("abcd"), rng.choice("pqr") if rng.random() < 0.8 else "?x", term("abcd"), rng.choice([None, None, "en"])) for _ in range(rng.randint(1, 3))]
        if not all(t.variables() for t in asked):
            continue
        got = sorted(sorted((c, r[c]) for c in r.asDict()) for r in p.match(triples, *asked).collect())
        assert got == brute(rows, asked), asked


def test_optional_union_and_holds(spark):
    rows = [("w1", "id", "1", None), ("w2", "id", "2", None), ("w1", "by", "j1", None), ("j1", "name", "Ann", "en"), ("j1", "name", "Anne", "fr"), ("w2", "by", "j2", None)]
    triples = spark.createDataFrame(rows, "s string, p string, o string, lang string")
    works, judge = p.match(triples, T("?w", "id", "?n")), p.match(triples, T("?w", "by", "?j"), T("?j", "name", "?name", "en"))
    assert sorted((r.n, r.name) for r in p.optional(works, judge).collect()) == [("1", "Ann"), ("2", None)]
    both = p.union(works.select("n"), judge.select("name")).collect()
    assert sorted(map(repr, both)) == sorted(["Row(n='1', name=None)", "Row(n='2', name=None)", "Row(n=None, name='Ann')"])
    assert [r.n for r in p.holds(works, triples, T("?j", "name", "?x"), T("?w", "by", "?j")).collect()] == ["1"]
    none = triples.limit(0)
    assert p.match(none, T("?w", "id", "?n"), T("?w", "by", "?j")).collect() == [] and p.holds(works, none, T("?w", "by", "?j")).collect() == []


def test_only_the_asked_predicates_are_read_and_the_rarest_comes_first(spark):
    rows = [(f"w{k}", "id", str(k), None) for k in range(200)] + [(f"w{k}", "by", f"j{k % 9}", None) for k in range(200)] + [("j3", "name", "Ann", None), ("w1", "far", "x", None)]
    triples = p.store(spark.createDataFrame(rows, "s string, p string, o string, lang string"), f"{scratch(spark, 'patterns')}/t")
    asked = [T("?w", "id", "?n"), T("?w", "by", "?j"), T("?j", "name", "Ann")]
    assert [t.p for t in p.order(triples, asked)] == ["name", "by", "id"]
    found = p.match(triples, *asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 22 and plan.count("PartitionFilters: [isnotnull(p") == 3


def test_lines_that_are_there_twice_are_two_expressions(spark):
    """Names of expressions made of keys alone are shared by equal lines; a join over them multiplies."""
    import datetime as dt

    d = scratch(spark, "twice")
    line = [(1, 5, 7, 1, 20.0, 0.05, "N", "O"), (1, 5, 7, 1, 20.0, 0.05, "N", "O"), (1, 5, 7, 1, 30.0, 0.05, "N", "F"), (1, 6, 7, 2, 20.0, 0.05, "N", "O")]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1, dt.datetime(1996, 1, 2), "F")], "o_orderkey long, o_orderdate timestamp, o_orderstatus string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(7, "Ann", 3)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(3, "X")], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    assert [tuple(r) for r in q.QUERIES["pattern_manifestations"](spark, d).collect()] == [("61996CJ0000001", "me1-1-5-7/DOC_1", 4)]
