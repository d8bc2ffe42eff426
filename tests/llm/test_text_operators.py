import random
import zlib

import numpy as np
import pytest

from lexgrain.llm import language_id, packing, piece_codec, quality_rules, queries, token_counts, url_filters
from lexgrain.llm.bpe import id_encoder

from . import brute

NASTY = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "½", "!", "<|endoftext|>", "'s", "'LL", "\x1c", "\x85", "\u00a0", "\u3000", "中", "🙂", "word", "The", "\u0301", "\r\n", "\x00", "x" * 70]


def nasty(n, seed=1, most=14):
    r = random.Random(seed)
    return [None, "", *("".join(r.choice(NASTY) for _ in range(r.randint(0, most))) for _ in range(n))]


def frame(spark, texts):
    """Documents with columns whose names operators might use themselves, and one repeated row."""
    rows = [(k, t, "x", k) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, cls string, n long").repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.bpe_vocabulary().json_path)


def test_token_counts_are_the_librarys(spark, library):
    texts = [*nasty(3000), "long " * 60_000, "x" * 100_000]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(frame(spark, texts), queries.bpe_vocabulary()).collect()}
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == {k: (len((t or "").encode()), n, n > 1024) for k, (t, n) in enumerate(zip(texts, want))}
    assert token_counts.token_counts(frame(spark, texts).where("doc_id < 0"), queries.bpe_vocabulary()).count() == 0


def test_ids_are_the_librarys_with_a_small_memo(library):
    v = queries.bpe_vocabulary()
    enc = id_encoder(v.json_path, v.ranks_path, v.pattern, memo=50)
    for t in nasty(2000, 2)[1:]:
        assert np.frombuffer(b"".join(enc.values(t)), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "one" + "\n" * 2_000_000 + "two", "one" + "\t" * 2_000_000 + " two.", "a" + " \n" * 600_000, "x" * 1_500_000, "中文" * 200_000 + "。" * 9])
def test_very_long_runs_are_the_librarys(library, text):
    v = queries.bpe_vocabulary()
    want = library.encode(text, add_special_tokens=False).ids
    assert token_counts.count_texts([text, "and"], v).tolist() == [len(want), 1]
    assert np.array_equal(np.frombuffer(b"".join(id_encoder(v.json_path, v.ranks_path, v.pattern).values(text)), "<u4"), want)


def test_slabs_and_pieces_of_frequency_tables_change_nothing(library, monkeypatch):
    from lexgrain.llm import bpe

    monkeypatch.setattr(bpe, "SLAB", 20)
    monkeypatch.setattr(token_counts, "TOGETHER", 30)
    texts = [" ".join(map(str, t)) for t in zip(nasty(900, 5)[2:], nasty(900, 6)[2:], nasty(900, 7)[2:])]
    assert all("".join(bpe.slabs(t)) == t for t in texts)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(texts, queries.bpe_vocabulary()).tolist() == want


def test_packing_places_every_id_once(spark, library):
    r = random.Random(4)
    texts = [*nasty(60), *(" ".join(r.choice("lorem ipsum dolor sit amet".split()) for _ in range(r.randint(1, 3000))) for _ in range(80))]
    rows = packing.pack(frame(spark, texts), queries.bpe_vocabulary()).collect()
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    for x in rows:
        part = np.array(ids[x.doc_id][x.start : x.start + x.length], "<u4")
        assert zlib.crc32(part.tobytes()) == x.ids_crc32 and (x.length == 1024 or x.piece == 0)
    bins = {}
    for x in rows:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(b, b[1:])) and sum(b[-1]) <= 1024
    total = sum(x.length for x in rows)
    assert total == sum(map(len, ids.values())) + len(ids[len(texts) - 1])
    assert len(bins) <= -(-total // 1024) * 1.05 + 1
    assert packing.pack(frame(spark, texts).where("doc_id < 0"), queries.bpe_vocabulary()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_and_wastes_little(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 1025 if seed % 2 else 300, 5000)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))
    used: dict[int, int] = {}
    bins = packing.plan(histogram, 1024)
    for times, use in bins:
        assert sum(k * n for k, n in use.items()) <= 1024
        for k, n in use.items():
            used[k] = used.get(k, 0) + times * n
    assert used == histogram and sum(t for t, _ in bins) <= lengths.sum() / 1024 * 1.01 + 1


def test_best_two_fit_replaces_the_smallest():
    # 600 + 300 leaves 124; 300 goes for 250 + 170, which fill the gap of 424 to 4
    bins = packing.plan({600: 1, 300: 1, 250: 1, 170: 1}, 1024)
    assert {600: 1, 250: 1, 170: 1} in [use for _, use in bins]


def test_sentencepiece_best_path_and_round_trip(spark):
    import public_tokenizers as p

    codec = piece_codec.Codec(p.path("piece_bpe_32k.model"))
    pieces = {w: (i, s) for w, (_, i, s) in codec._auto.items()}

    def best(s):
        score = [0.0] + [-np.inf] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - 20), j):
                gain = pieces[s[i:j]][1] if s[i:j] in pieces else codec._unk_score if j - i == 1 else -np.inf
                score[j] = max(score[j], score[i] + gain)
        return score[-1]

    by_id = {i: s for i, s in pieces.values()}
    texts = [t for t in nasty(400, 5) if t]
    for t in texts:
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        marked = "▁" + t.replace(" ", "▁")
        unknown = sum(c not in pieces for c in marked)
        assert abs(sum(by_id.get(i, 0.0) for i in ids) + unknown * codec._unk_score - best(marked)) <= 1e-9 * abs(best(marked)) + 1e-6
        assert codec.decode(codec.encode(t)) == t
    rows = piece_codec.digest(frame(spark, nasty(50)), piece_codec.PieceModel(p.path("piece_bpe_32k.model"))).collect()
    assert len(rows) == 53 and all(r.round_trip for r in rows)
    own = frame(spark, ["a b", None, ""])
    model = piece_codec.PieceModel(p.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.text for r in piece_codec.decode(piece_codec.encode(own, model), model).collect()} == {0: "a b", 1: "", 2: ""}


def test_sentencepiece_parts_and_long_stretches(monkeypatch):
    import tracemalloc

    import public_tokenizers as p

    codec = piece_codec.Codec(p.path("piece_bpe_32k.model"))
    r = random.Random(12)
    text = "".join(r.choice(["the", "中", "文", "é", "🙂", "x" * 40, "\n\n\n", "ing", "0"]) for _ in range(4000))
    whole = codec.viterbi(text)
    monkeypatch.setattr(piece_codec, "SLAB", 500)
    score = lambda ids: sum(s for _, (_, i, s) in codec._auto.items() for _ in range(ids.count(i)))
    parts = codec.viterbi(text)
    assert abs(score(parts) - score(whole)) < 1e-6 * abs(score(whole)) and sum(i < 300 for i in parts) == sum(i < 300 for i in whole)
    monkeypatch.undo()
    long = "".join(r.choice("etaoinshrdlu") for _ in range(50_000)) * 12
    tracemalloc.start()
    ids = codec.encode(long)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert codec.decode(ids) == long and most < 60e6


def test_url_filters_against_brute_force(spark):
    r = random.Random(6)
    hosts = ["com", "example.com", "a.example.com", "EXAMPLE.com", "net", "x.net", "org", "", "a..com", "com.", "-.com", "example.com:80", "xcom", "\u0001.com"]
    paths = ["", "/", "/en/", "/en/7", "/en/77?x=/de/", "/de/8#a", "/e", "/en", "/\u0001"]
    urls = [None, "", "no scheme", "://", "http://", "a://b://c/en/", *(f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(400))]
    for rules in (queries.URL_RULES, [("com", "", "block"), ("example.com", "/", "allow"), ("example.com", "/en/", "block"), ("a.example.com", "/en", "allow"), ("net", "/d", "block")], []):
        pages = spark.createDataFrame([(k, u, "c") for k, u in enumerate([*urls, urls[-1]])], "page_id long, url string, host string")
        got = url_filters.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
        assert not [x for x in got._jdf.queryExecution().executedPlan().toString().split() if "Python" in x]
        assert {x.page_id: tuple(x)[1:] for x in got.collect()} == {k: brute.url_verdict(u, rules) for k, u in enumerate([*urls, urls[-1]])}
    assert url_filters.filter_urls(pages.limit(0), spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")).count() == 0


def test_many_rules_of_one_host(spark):
    import time

    from pyspark.sql import functions as F

    n = 200_000
    path = F.concat(F.lit("/"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "/deep/er").otherwise(""))
    rules = spark.range(n).select(F.lit("example.com").alias("host"), path.alias("path"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"))
    pages = spark.createDataFrame([(1, "http://a.example.com/123456/deep/er/x"), (2, "http://example.com/123456/other"), (3, "http://example.com/199999999"), (4, "http://com/1")], "page_id long, url string")
    start = time.time()
    got = {x.page_id: (x.rule, x.verdict) for x in url_filters.filter_urls(pages, rules, default="none").collect()}
    assert got == {1: ("example.com/123456/deep/er", "block"), 2: ("example.com/12345", "allow") if 12345 % 3 else ("example.com/1234", "block"), 3: ("example.com/199999", "allow") if 199999 % 3 else None, 4: (None, "none")}
    assert time.time() - start < 100


def test_quality_counts(spark):
    r = random.Random(7)
    texts = [None, "", "\n \n", *(" ".join(r.choice("a b c d| \n É! 1".split(" ")) for _ in range(r.randint(0, 40))) for _ in range(300)), "w " * 50_000]
    rows = quality_rules.with_features(frame(spark, texts), carry=["doc_id"]).select("__row.doc_id", *quality_rules.COUNTS[:5]).collect()
    assert {x[0]: tuple(x)[1:] for x in rows} == {k: brute.quality_counts(t) for k, t in enumerate(texts)}


def test_decision_list_learns_a_conjunction_and_ties():
    r = np.random.default_rng(8)
    x = {"symbols_per_word": r.random(3000), "upper_share": r.random(3000)}
    bad = (x["symbols_per_word"] > 0.6) & (x["upper_share"] <= 0.3)
    rules = quality_rules.learn(x, bad, np.arange(3000) % 3 == 2)
    said = np.logical_or.reduce([rule.holds(x) for rule in rules])
    assert (said == bad).mean() > 0.98
    same = {"symbols_per_word": np.zeros(60)}
    assert quality_rules.learn(same, np.arange(60) % 2 == 0, np.arange(60) % 3 == 2) == []


def test_quality_query_keeps_good_documents(spark):
    rows = queries.op7_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    table = {(r.kept, r.quality): r["count"] for r in rows.groupBy("kept", "quality").count().collect()}
    assert table.get((False, 1), 0) == 0 and table.get((True, 0), 0) == 0 and table[(True, 1)] > 100
    empty = spark.createDataFrame([], "doc_id long, quality int")
    featured = quality_rules.with_features(frame(spark, ["word " * 60]), carry=["doc_id"]).select("__row.doc_id", *quality_rules.COUNTS)
    assert quality_rules.fit(featured, empty) == []


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("", "de"), ("xx", None)], "text string, lang string")
    model = language_id.fit(train)
    rows = language_id.identify(frame(spark, [None, "", "123 !", "und der", "the dog", "the dog " * 50_000]), model).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {0: "und", 1: "und", 2: "und", 3: "de", 4: "en", 5: "en"}
    none = language_id.fit(train.where("lang = 'zz'"))
    assert {r.lang_pred for r in language_id.identify(frame(spark, ["abc"]), none).collect()} == {"und"}
    assert language_id.reject(frame(spark, [None, "the dog"]), model).select("doc_id", "cls").collect()[0].doc_id == 1


def plain_languages(train):
    """Naive Bayes with plain counters: (texts) -> (language, posterior)."""
    import math
    import zlib  # noqa: F401
    from collections import Counter

    def grams(t):
        out, s = [], " "
        for c in (t or "").lower():
            s += c if c.isalpha() else "" if s.endswith(" ") else " "
        if not s.strip():
            return None
        s += " "
        for n in language_id.ORDERS:
            for k in range(len(s) - n + 1):
                if n > 1 or s[k] != " ":
                    h = n
                    for c in s[k : k + n]:
                        h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % 2**64
                        h ^= h >> 29
                    out.append(h % language_id.BUCKETS)
        return Counter(out)

    languages = sorted({la for _, la in train if la is not None})
    counts = {la: sum((grams(t) or Counter() for t, x in train if x == la), Counter()) for la in languages}
    total = {la: sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS for la, c in counts.items()}
    rows = {la: sum(x == la for _, x in train) + 1 for la in languages}

    def predict(t):
        g = grams(t)
        if g is None or not languages:
            return "und", 0.0
        s = {la: math.log(rows[la] / sum(rows.values())) + sum(n * math.log((counts[la][b] + language_id.SMOOTHING) / total[la]) for b, n in g.items()) for la in languages}
        best = max(languages, key=lambda la: s[la])
        return best, 1 / sum(math.exp(min(700, v - s[best])) for v in s.values())

    return predict


def test_languages_against_plain_counters(spark):
    import zlib

    rows = [(x.doc_id, x.text and x.text[:400], x.lang) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(5000 + k, t, "en" if k % 5 else None) for k, t in enumerate(nasty(60, 3))] + [(6000, "der the le", "de")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    predict = plain_languages([(t, la) for i, t, la in rows if not held(i)])
    model = language_id.fit(docs.where(~queries.held_out()))
    got = {x.doc_id: (x.lang_pred, x.score, x.held_out) for x in language_id.identify(docs, model).withColumn("held_out", queries.held_out()).collect()}
    for i, t, _ in rows:
        la, score = predict(t)
        assert got[i][0] == la and abs(got[i][1] - score) < 1e-3 and got[i][2] == held(i), i


def test_parts_of_long_texts_give_the_same_counts(monkeypatch):
    texts = ["".join(t) for t in zip(nasty(300, 8)[2:], nasty(300, 9)[2:], nasty(300, 10)[2:])] + ["Été " * 50, "ab" * 90]
    whole = [language_id.ngram_counts(t) for t in texts]
    monkeypatch.setattr(language_id, "SLAB", 7)
    for t, w in zip(texts, whole):
        c = language_id.ngram_counts(t)
        assert (c is None) == (w is None) and (c is None or all(map(np.array_equal, c, w))), t


def test_language_of_very_long_texts_in_bounded_memory():
    import tracemalloc

    many = language_id.Model(tuple(f"l{k:03}" for k in range(64)), np.random.default_rng(1).normal(-9, 1, (language_id.BUCKETS, 64)).astype(np.float32), np.zeros(64))
    text = "one two, three " * 1_400_000
    language_id.ngram_counts("a")
    tracemalloc.start()
    got = many.predict([text, "one"])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300e6 and got[0].score > 0.5 and got[1].language != "und"


def test_texts_in_no_learned_language_are_rejected(spark):
    r = random.Random(1)
    model = language_id.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    odd = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(60)),
    ]
    good = ["All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience.", "The", "of the and"]
    assert [v.fits for v in model.predict([*odd, *good])] == [False] * 3 + [True] * 3
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert language_id.reject(docs, model).count() == docs.count()
    assert language_id.reject(docs.limit(5).withColumn("text", __import__("pyspark").sql.functions.lit(odd[0])), model).count() == 0


def test_op3_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute("create view pages as select * from read_parquet('/root/testdata/sf0.01/pages.parquet')")
    got = sorted(map(tuple, queries.op3_url_filters(spark, "/root/testdata/sf0.01").collect()), key=repr)
    assert got == sorted(c.execute(queries.OP3_SQL).fetchall(), key=repr)


def test_quality_counts_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute("create view documents as select * from read_parquet('/root/testdata/sf0.01/documents.parquet')")
    assert sorted(map(tuple, queries.quality_counts(spark, "/root/testdata/sf0.01").collect())) == sorted(c.execute(queries.QUALITY_SQL).fetchall())


def test_every_operator_has_a_query():
    names = {f.__name__.split("_")[0] for f in queries.OPERATORS}
    assert names == {f"op{k}" for k in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(queries.queries())


