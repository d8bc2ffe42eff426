import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrain.functions import fulltext, text
from lexgrain.functions.fulltext import parse_web_query


def test_web_query_parser():
    assert parse_web_query('"of the" -from or und') == [[(True, ["of", "the"]), (False, ["from"])], [(True, ["und"])]]
    assert parse_web_query("or") == []


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet='ab "-or', max_size=20))
def test_web_query_parser_never_fails(q):
    assert all(words for group in parse_web_query(q) for _, words in group)


def brute_cover(tokens, words):
    covers = []
    for i in range(len(tokens)):
        for j in range(i, len(tokens)):
            if set(words) <= set(tokens[i : j + 1]) and tokens[i] in words and tokens[j] in words:
                covers.append((i, j))
    least = [c for c in covers if not any(o != c and o[0] >= c[0] and o[1] <= c[1] for o in covers)]
    return sum(0.1 / (1 + (j - i) - (sum(t in words for t in tokens[i : j + 1]) - 1)) for i, j in least)


def test_cover_density_against_brute_force(spark):
    r = random.Random(3)
    docs = [(k, " ".join(r.choice("abcdxyz") for _ in range(r.randint(0, 25)))) for k in range(60)] + [(99, None)]
    post = fulltext.postings(spark.createDataFrame(docs, "id int, t string"), "id", "t").cache()
    for words in (["a"], ["a", "b"], ["a", "b", "c"]):
        got = {x.id: x["rank"] for x in fulltext.cover_density(post, "id", words).collect()}
        want = {k: brute_cover((t or "").split(), set(words)) for k, t in docs}
        assert set(got) == {k for k, v in want.items() if v} and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_unicode_strip_and_chunks(spark):
    df = spark.createDataFrame([(1, "  one two \n\n  x \n\n" + "y" * 90), (2, None), (3, "")], "id int, t string")
    rows = text.chunks(df, "id", "t", "\n\n", 5, 50).collect()
    assert [(r.id, r.chunk_index, len(r.chunk)) for r in rows] == [(1, 0, 7), (1, 2, 50)]


def test_paragraph_numbers_leave_gaps(spark):
    long = "p" * 80
    df = spark.createDataFrame([("c", [long, "short", long, " " + long, None], [7, None, None])], "celex string, paragraphs array<string>, paragraph_nums array<int>")
    rows = text.paragraphs(df).collect()
    assert [(r.id, r.paragraph_number) for r in rows] == [("c_p_0", 7), ("c_p_2", None), ("c_p_3", 4)]


def test_titles(spark):
    raw = "Judgment of 1 May 2000.#SIA 'Oribalt' v Valsts.#Request#Case C-1/00"
    html = '<p id="title">Judgment of the Court (First) of 1 May. Alpha BV v Beta. Request for x.</p>'
    df = spark.createDataFrame([(raw, html)], "raw string, html string")
    a, b = text.title_fields(F.col("raw")), text.title_html(F.col("html"))
    row = df.select(a[1].alias("p"), b[1].alias("q")).first()
    assert row.p == ["SIA 'Oribalt", "Valsts"] and row.q == ["Alpha BV", "Beta"]
