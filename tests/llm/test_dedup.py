import random

import numpy as np
import pytest

from lexgrain.llm import embedding_neardup, ngram_jaccard, suffix_dedup
from lexgrain.llm.shingles import shingles

from . import brute

EDGES = [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "One  TWO"), (9005, "one two three"), (9003, "another text of this id with several words"), (9003, "another text of this id with several words")]


def near_copies(r, n, words, changes, first):
    base = [f"w{r.randint(0, 3000)}" for _ in range(words)]
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(0, changes)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 99)}"
        yield first + k, " ".join(w)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cls string, n long").repartition(4)


@pytest.mark.parametrize("hot", [2000, 3])
def test_jaccard_components(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_jaccard, "HOT", hot)
    r = random.Random(hot)
    rows = [*near_copies(r, 60, 150, 8, 0), *near_copies(r, 40, 40, 3, 100), *near_copies(r, 20, 12, 2, 200), *EDGES]
    rows += [(300 + k, " ".join(f"v{r.randint(0, 40)}" for _ in range(r.randint(1, 60)))) for k in range(60)]
    got = sorted(map(tuple, ngram_jaccard.components(docs(spark, rows)).collect()))
    assert got == brute.jaccard_components(rows)


def test_jaccard_empty_and_single(spark):
    assert ngram_jaccard.components(docs(spark, EDGES).limit(0)).count() == 0
    assert [tuple(x) for x in ngram_jaccard.components(docs(spark, [(5, "a b c d e f")])).collect()] == [(5, 2, 5)]


def test_one_per_group_keeps_columns_and_the_least(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "something else entirely here now"), (4, None)]
    out = ngram_jaccard.one_per_group(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "cls", "n"] and sorted(x.doc_id for x in out.collect()) == [1, 2, 4]


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    """Repeated rows, ids with several texts, near copies under one id, null ids."""
    r = random.Random(5)
    near = [t for _, t in near_copies(r, 6, 60, 2, 0)]
    alone = [" ".join(f"{c}{k}" for k in range(30)) for c in "pqrstu"]
    rows = [(1, alone[0])] * 3 + [(2, near[0]), (2, near[1]), (2, alone[1]), (3, near[2]), (3, alone[2]), (None, alone[3]), (None, alone[3]), (None, alone[4]), (7, alone[4]), (8, None), (8, None), (9, ""), (9, " ")]
    got = sorted(((x.doc_id, x.text) for x in ngram_jaccard.one_per_group(docs(spark, rows)).collect()), key=repr)
    rest = [x for x in got if x[1] not in near]
    assert rest == sorted([(1, alone[0]), (2, alone[1]), (3, alone[2]), (None, alone[3]), (7, alone[4]), (8, None), (8, None), (9, ""), (9, " ")], key=repr)
    assert [i for i, t in got if t in near] == [2]


def test_all_links_between_classes_and_their_members(spark):
    r = random.Random(9)
    rows = [*near_copies(r, 30, 60, 6, 0), (30, "a b c d e f"), (31, "A b c d  e f"), (32, None)]
    sets = brute.shingle_sets(rows)
    pairs, members = ngram_jaccard.links(docs(spark, rows))
    of = {x.doc_id: x["class"] for x in members.collect()}
    found = {(x.a, x.b) for x in pairs.collect()}
    assert of[30] == of[31] == 30 and of[32] is None
    for i in range(32):
        for k in range(i):
            common = len(sets[i] & sets[k])
            want = 100 * common >= 80 * (len(sets[i]) + len(sets[k]) - common)
            assert want == (of[i] == of[k] or (min(of[i], of[k]), max(of[i], of[k])) in found)


def test_suffix_bound_is_a_bound():
    r = np.random.default_rng(1)
    for _ in range(200):
        pool = r.integers(0, 2**64, 300, dtype=np.uint64)
        x, y = (np.unique(r.choice(pool, r.integers(1, 250))) for _ in range(2))
        least = np.array([min(len(x), len(y))])
        bound = ngram_jaccard.suffix_bounds([ngram_jaccard.part_sizes(x)], [ngram_jaccard.part_sizes(y)], least)[0]
        assert len(np.intersect1d(x, y)) <= bound <= least[0]
    assert ngram_jaccard.suffix_bounds([b""], [ngram_jaccard.part_sizes(x)], np.array([7])).tolist() == [7]
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles(" ")) == 0


@pytest.mark.parametrize("most", [256, 4])
def test_repeated_strings(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    r = random.Random(most)
    word = lambda n, a="abcdefgh é": "".join(r.choice(a) for _ in range(n))
    base, common = word(1500), word(500)
    rows = [(9100, "a" * 1000), (9101, "ab" * 300), (9102, "x" * 399), (9103, "x" * 400), (9104, "y" * 400), (9105, "y" * 400), (9106, "q" * 401), (9107, base[:700] + base[:700]), *EDGES]
    for k in range(25):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "X"
        rows.append((k, "".join(w)))
    rows += [(100 + k, word(r.randint(0, 200), "ijkl") + common[r.randint(0, 60) :] + word(r.randint(0, 200), "mnop")) for k in range(80)]
    got = sorted(map(tuple, suffix_dedup.dedup_report(docs(spark, rows), length=400).collect()))
    assert got == brute.repeats(rows, 400)


def test_frequent_strings_are_looked_at_in_runs_first(spark):
    """Each start of each context of a frequent key was a row; the count grew faster than the table."""
    r = random.Random(5)
    shared = bytes(r.choices(b"abcdefgh", k=430))
    rows = [(1, k, k, 600, 0, 100, bytes([128 + k]) * 40 + shared + bytes([128 + k]) * 29, True, 100) for k in range(50)]
    contexts = spark.createDataFrame(rows, "key long, hc long, cls long, n long, lo long, starts long, content binary, hot boolean, anchor long")
    found, (each, _, _, alone) = suffix_dedup._covered_parts(contexts, 400)
    got = {}
    for x in found.collect():
        got.setdefault(x.cls, set()).update(range(x.start, x.start + x.bytes))
    assert got == {k: set(range(40, 470)) for k in range(50)}
    assert each.count() + alone.count() < 50 * 100 * 0.7
    suffix_dedup.discard(each, alone)


@pytest.mark.parametrize("most", [256, 3])
def test_repeat_groups_have_every_occurrence(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    r = random.Random(17)
    word = lambda n, a="abcdefgh": "".join(r.choice(a) for _ in range(n))
    common = [word(r.randint(50, 120)) for _ in range(4)]
    rows = [(k, word(r.randint(0, 60), "ijkl") + r.choice(common) + word(r.randint(0, 60), "mnop") + r.choice(common)[: r.randint(20, 50)]) for k in range(25)]
    rows += [(50, rows[0][1]), (51, "z" * 70), (52, None)]
    raw = {i: (t or "").encode() for i, t in rows}
    groups = {}
    for x in suffix_dedup.repeat_groups(docs(spark, rows), length=40).collect():
        groups.setdefault((bytes(x.repeat), x.bytes), set()).add((x.doc_id, x.start))
    covered = {i: bytearray(len(b)) for i, b in raw.items()}
    for (_, n), places in groups.items():
        strings = {raw[i][s : s + n] for i, s in places}
        assert len(strings) == 1 and len(places) > 1 and n >= 40 and len(next(iter(strings))) == n
        want = {(i, s) for i, b in raw.items() for s in range(len(b) - n + 1) if b[s : s + n] in strings}
        assert places == want
        for i, s in places:
            covered[i][s : s + n] = b"\1" * n
    assert sorted((i, sum(c)) for i, c in covered.items()) == [(i, gone) for i, _, gone, _, _ in brute.repeats(rows, 40)]


def test_repeats_of_empty_table_and_short_lengths(spark):
    assert suffix_dedup.dedup_report(docs(spark, EDGES).limit(0)).count() == 0
    rows = [(k, t) for k, t in enumerate(["abcabcabcabcabcabcabc", "zzabcabcabcabcabcqq", "nothing of the kind here", "qq" * 20])]
    assert sorted(map(tuple, suffix_dedup.dedup_report(docs(spark, rows), length=16).collect())) == brute.repeats(rows, 16)


def test_long_texts_are_cut_into_slabs(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice("abcd") for _ in range(3000)).encode()
    whole = suffix_dedup.anchors(text, 400)
    monkeypatch.setattr(suffix_dedup, "SLAB", 700)
    a, lo, hi = suffix_dedup.anchors(text, 400)
    expand = lambda x, y, z: {p: int(v) for v, s, e in zip(x, y, z) for p in range(s, e + 1)}
    assert expand(a, lo, hi) == expand(*whole) and sorted(expand(*whole)) == list(range(len(text) - 399))


def test_maximal_repeats_have_all_occurrences_and_diverse_left_ends():
    contexts = [b"1abcdefgh2", b"3abcdefgh4", b"3abcdefgx4"]
    found = {(n, contexts[o[0][0]][o[0][1] : o[0][1] + n]): sorted(o) for n, o in suffix_dedup.maximal_repeats(contexts, [6, 6, 6], 5)}
    assert found[(8, b"abcdefgh")] == [(0, 1), (1, 1)]
    assert found[(7, b"abcdefg")] == [(0, 1), (1, 1), (2, 1)]
    assert found[(8, b"3abcdefg")] == [(1, 0), (2, 0)]
    assert not any(s.startswith(b"bcd") for _, s in found)


def test_runs_cover_what_the_groups_cover_and_do_not_multiply():
    rng, length = random.Random(5), 5
    for _ in range(30):
        contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 6))]
        starts = [len(c) - length + 1 for c in contexts]
        groups = {(i, at) for n, found in suffix_dedup.maximal_repeats(contexts, starts, length) for i, o in found for at in range(o, o + n)}
        runs = suffix_dedup.covered_runs(contexts, starts, length)
        assert {(i, at) for i, o, n in runs for at in range(o, o + n)} == groups
    # prefixes of one string, each a repeat within the longer ones: groups have the square of their number, runs one each
    nested = [b"".join(bytes([65 + k]) for k in range(20 + m)) + bytes([200 + m]) for m in range(30)]
    assert sum(len(o) for _, o in suffix_dedup.maximal_repeats(nested, [1] * 30, 10)) > 400
    assert len(suffix_dedup.covered_runs(nested, [1] * 30, 10)) == 30
    assert suffix_dedup.covered_runs([], [], 10) == []


def test_removed_passages_keep_characters_whole(spark):
    common = "é" * 150
    rows = [(1, "ä" + common + "ö one"), (2, "ü" + common + "ß two"), (3, None), (4, "alone")]
    out = {x.doc_id: x.text for x in suffix_dedup.remove_repeats(docs(spark, rows), length=200).collect()}
    assert out == {1: "äö one", 2: "üß two", 3: None, 4: "alone"}


def vectors(spark, v, first=0):
    return spark.createDataFrame([(first + k, None if x is None else [None if e is None else float(e) for e in x], 1, "c") for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int, cls string")


@pytest.mark.parametrize("block", [1024, 40])
def test_vector_links_recall(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_neardup, "BLOCK", block)
    r = np.random.default_rng(block)
    x = r.standard_normal((1200, 32)).astype(np.float32)
    for k in range(300):
        g = r.standard_normal(32)
        u = x[k] / np.linalg.norm(x[k])
        g -= (g @ u) * u
        c = r.uniform(0.86, 0.99)
        x[900 + k] = c * u + np.sqrt(1 - c * c) * g / np.linalg.norm(g)
    x[100:160] = x[100] + 0.05 * r.standard_normal((60, 32))
    all_rows = [*x, x[3], x[3], 2 * x[4], None, [0.0] * 32, [np.nan, *[1.0] * 31], [None, *[1.0] * 31], [np.inf, *[1.0] * 31], [], [1.0, 2.0]]
    n = 1203
    rows = sorted(map(tuple, embedding_neardup.near_duplicates(vectors(spark, all_rows).repartition(3)).collect()))
    a = np.stack([np.asarray(v, dtype=np.float32) for v in all_rows[:n]]).astype(float)
    a /= np.linalg.norm(a, axis=1)[:, None]
    s = a @ a.T >= 0.9
    np.fill_diagonal(s, False)
    links = np.array([t[1] for t in rows[:n]])
    assert links.sum() >= 0.95 * s.sum() and (links <= s.sum(1)).all() and links.sum() % 2 == 0
    assert all(t[1:] == (0, t[0], True) for t in rows[n:])
    assert all(t[3] == (t[0] == t[2]) and t[2] <= t[0] for t in rows)


def planted(r, n, pairs, dims, low=0.9, high=0.93):
    """Random vectors, of which the last ``pairs`` are neighbours of the first at cosines from ``low`` to ``high``."""
    x = r.standard_normal((n, dims)).astype(np.float32)
    u = x[:pairs] / np.linalg.norm(x[:pairs], axis=1, keepdims=True)
    g = r.standard_normal((pairs, dims))
    g -= (g * u).sum(1)[:, None] * u
    c = r.uniform(low + 1e-4, high, pairs)[:, None]
    x[n - pairs :] = c * u + np.sqrt(1 - c * c) * g / np.linalg.norm(g, axis=1, keepdims=True)
    return x


def test_vectors_beyond_the_sample_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(embedding_neardup, "SAMPLE", 2_000)
    x = planted(np.random.default_rng(4), 12_000, 1_500, 24)
    rows = {t[0]: t[1] for t in embedding_neardup.near_duplicates(vectors(spark, x)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = sum(int((u[k : k + 2000] @ u.T >= 0.9).sum()) for k in range(0, len(u), 2000)) - len(u)
    assert want >= 3_000 and 0.97 * want <= sum(rows.values()) <= want


def test_vectors_of_every_dimension_are_compared(spark):
    """Against the SQL twin: two dimensions with many vectors, some with few."""
    import duckdb
    import pyarrow as pa

    from lexgrain.llm import queries

    r = np.random.default_rng(6)
    rows = [*planted(r, 500, 120, 16), *planted(r, 300, 90, 7), *planted(r, 20, 8, 3), [1, 2], [2, 4], [-1, -2], [5.0], [2.0], [-3.0], [], None, [0, 0], [np.inf, 1]]
    rows = [None if v is None else [float(e) for e in v] for v in rows]
    got = sorted(map(tuple, embedding_neardup.near_duplicates(vectors(spark, rows).repartition(3)).collect()))
    c = duckdb.connect()
    c.register("embeddings", pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}))
    want = sorted(c.execute(queries.OP6_SQL).fetchall())
    missed = sum(w[1] for w in want) - sum(g[1] for g in got)
    assert 0 <= missed <= 0.02 * sum(w[1] for w in want) and got[800:] == want[800:]


def test_vectors_empty_and_all_equal(spark):
    assert embedding_neardup.near_duplicates(vectors(spark, []).limit(0)).count() == 0
    rows = sorted(map(tuple, embedding_neardup.near_duplicates(vectors(spark, [[1, 2, 3]] * 5)).collect()))
    assert rows == [(k, 4, 0, k == 0) for k in range(5)]


def test_many_texts_of_one_id_and_of_none(spark):
    """Near copies and others that share an id, or have none: as many rows as texts are met, each by its own class."""
    import time

    base = [f"w{k}" for k in range(60)]
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(60)]
    far = [" ".join(f"y{k}_{j}" for j in range(9)) for k in range(200)]
    rows = [(7, t) for t in near + far] + [(None, t) for t in near[:20] + far[:20]]
    found = ngram_jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows) and all(r.component_id == 7 for r in found)
    many = [(3, f"{t} {k}") for k in range(80) for t in near + far]  # 20,800 texts of one id
    frame = spark.createDataFrame(many, "doc_id long, text string").repartition(8).cache()
    frame.count()
    start = time.perf_counter()
    assert ngram_jaccard.components(frame).where("component_id = 3").count() == len(many)
    assert time.perf_counter() - start < 120
    frame.unpersist()


def test_one_very_long_text(spark):
    long = " ".join(f"v{k}" for k in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "a b c d e f")]
    got = sorted(map(tuple, ngram_jaccard.components(docs(spark, rows)).collect()))
    assert got == [(1, 299_996, 1), (2, 299_997, 1), (3, 2, 3)]
