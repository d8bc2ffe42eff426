import numpy as np

from lexgrain.operators import kept_ranks

SCHEMA = "src string, dst string, weight double"
#: Few rounds: ranks within tolerance / 0.15 / the sum of scores. The SQL twin of pagerank_refreshed holds the last digits.
LOOSE = {"tolerance": 1e-3}


def dense(edges):
    """Ranks by power iteration over a matrix."""
    ids = sorted({x for e in edges for x in e})
    m = np.zeros((len(ids),) * 2)
    for (s, d), w in edges.items():
        m[ids.index(s), ids.index(d)] = w
    out = m.sum(1)
    share = np.divide(m, out[:, None], out=np.zeros_like(m), where=out[:, None] > 0)
    r = np.full(len(ids), 1 / max(len(ids), 1))
    for _ in range(300):
        r = 0.15 / len(ids) + 0.85 * (r @ share + r[out == 0].sum() / len(ids))
    return dict(zip(ids, r, strict=True))


def frame(spark, edges):
    return spark.createDataFrame([(s, d, w) for (s, d), w in edges.items()], SCHEMA)


def ranks(kept):
    return {r.id: r.pagerank for r in kept.ranks().collect()}


def near(got, want):
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-4 for i in want)


def graph_of(seed, n=30, m=300):
    rng = np.random.default_rng(seed)
    edges = {(f"n{a:02d}", f"n{b:02d}"): float(w) for a, b, w in zip(rng.integers(0, n - 4, m), rng.integers(0, n, m), rng.integers(1, 5, m), strict=True)}
    edges |= {("n00", f"n{k:02d}"): 1.0 for k in range(1, n)}  # a hub
    return edges


def test_placed_edges_and_cells_of_a_hub(spark):
    edges = graph_of(2)
    near(ranks(kept_ranks.solve(frame(spark, edges), few=0, cell=7, **LOOSE)), dense(edges))


def test_refreshed_equals_afresh(spark):
    edges = graph_of(1)
    kept = kept_ranks.solve(frame(spark, edges), **LOOSE)
    near(ranks(kept), dense(edges))
    # a new source, a new target, a removed edge, all edges of a source gone, a node without any edge left, another weight
    after = {e: w for e, w in edges.items() if e[0] != "n05" and "n29" not in e}
    after |= {("new", "n03"): 2.0, ("n07", "leaf"): 1.0, ("n00", "n01"): 9.0, ("far", "n04"): 1.0}
    again = kept_ranks.refresh(kept, kept_ranks.changes(frame(spark, edges), frame(spark, after)), **LOOSE)
    near(ranks(again), dense(after))
    assert {(r.src, r.dst): r.weight for r in again.edges.collect()} == after


def test_work_grows_with_the_change(spark):
    """A change in one of many parts of a graph leaves the others alone."""
    edges = {(f"p{p:03d}-{i}", f"p{p:03d}-{j}"): 1.0 for p in range(40) for i, j in [(0, 1), (1, 2), (0, 2)]}
    kept = kept_ranks.solve(frame(spark, edges), **LOOSE)
    change = spark.createDataFrame([("p007-1", "p007-3", 1.0)], SCHEMA)
    again = kept_ranks.refresh(kept, change, **LOOSE)
    near(ranks(again), dense(edges | {("p007-1", "p007-3"): 1.0}))
    old = {r.id: (r.x, r.r) for r in kept.scores.collect()}
    assert {r.id for r in again.scores.collect() if (r.x, r.r) != old.get(r.id)} == {"p007-2", "p007-3"}
    assert 0 < again.pushed < kept.pushed / 2


def test_nulls_repeats_and_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    kept = kept_ranks.solve(empty, **LOOSE)
    assert ranks(kept) == {}
    near(ranks(kept_ranks.refresh(kept, frame(spark, {("a", "b"): 1.0}), **LOOSE)), dense({("a", "b"): 1.0}))
    odd = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 2.0), ("a", "c", 3.0), (None, "b", 1.0), ("b", None, 1.0), ("b", "z", None), ("b", "z", 0.0)], SCHEMA)
    kept = kept_ranks.solve(odd, **LOOSE)
    near(ranks(kept), dense({("a", "b"): 3.0, ("a", "c"): 3.0}))
    same = kept_ranks.refresh(kept, spark.createDataFrame([("q", "r", None), ("a", "b", 3.0), (None, "b", 1.0)], SCHEMA), **LOOSE)
    near(ranks(same), dense({("a", "b"): 3.0, ("a", "c"): 3.0}))
    assert same.pushed == 0
    all_gone = kept_ranks.refresh(kept, kept_ranks.changes(kept.edges, empty), **LOOSE)
    assert ranks(all_gone) == {} and all_gone.edges.count() == 0
