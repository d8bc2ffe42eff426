import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken

from lexgrain.llm import byte_bpe, importance, point_in_time, queries

FOLDER = "/root/testdata/sf0.001"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def rank_file():
    import public_tokenizers as p

    return byte_bpe.RankFile(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)


def library(file):
    return tiktoken.Encoding("own", pat_str=file.pattern, mergeable_ranks=byte_bpe.ranks(file.path), special_tokens={})


# ---- op11 ----------------------------------------------------------------------------------------------------------


def shop(rng, n, clients):
    """Tables whose times fall on few values, so that ends of windows and times tie, with nulls and repeated rows."""
    base = np.datetime64("2024-01-01T00:00:00", "us")
    when = lambda: None if rng.random() < 0.03 else (base + np.timedelta64(int(rng.integers(0, 80)) * 6, "h")).item()
    some = lambda x: None if rng.random() < 0.05 else x
    pick = lambda: some(int(clients[int(rng.integers(len(clients)))]))
    clicks = [(some(int(rng.integers(40))), when(), when(), pick(), some(["purchase", "view"][int(rng.integers(2))]), some(float(rng.integers(-500, 500)) / 100), some("{}")) for _ in range(2 * n)]
    sales = [(k, pick(), "done", some(float(rng.integers(0, 999)) / 100), when(), when(), 1) for k in range(n)]
    lines = [(some(int(rng.integers(n + 5))), 1, some(int(rng.integers(6))), 1, 1, some(float(rng.integers(0, 999)) / 100), 0.0, "kept", when()) for _ in range(4 * n)]
    return clicks + clicks[: n // 2], sales, lines + lines[: n // 2]


def duck(**tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(f"_{name}", df.toArrow())
        c.execute(f"create table {name} as select * from _{name}")
    return c


@pytest.mark.parametrize("seed,clients", [(1, [7]), (2, [7, 7, 7, 7, 1, 2, 3]), (3, range(60))])
def test_feature_table_against_joins(spark, seed, clients):
    clicks, sales, lines = shop(np.random.default_rng(seed), 120, list(clients))
    c, s, x = spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES)
    got = point_in_time.feature_table(c, s, x)
    want = duck(clicks=c, sales=s, sale_lines=x).execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP11_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_feature_table_without_rows_and_with_other_columns(spark):
    c, s, x = (spark.createDataFrame([], k) for k in (CLICKS, SALES, LINES))
    assert point_in_time.feature_table(c, s, x).collect() == []
    _, sales, _ = shop(np.random.default_rng(4), 20, [1])
    s = spark.createDataFrame(sales, SALES)
    plain = sorted(map(tuple, point_in_time.feature_table(c, s, x).collect()), key=repr)
    other = s.selectExpr("*", "1 AS client", "2 AS t", "3 AS d", "4 AS what")
    assert plain and sorted(map(tuple, point_in_time.feature_table(c, other, x).collect()), key=repr) == plain
    # repeated sale rows are asked and counted each
    twice = point_in_time.feature_table(c, s.union(s), x).collect()
    assert len(twice) == 2 * len(plain)
    assert sorted(r.n_sales for r in twice) == sorted(2 * r[8] for r in plain for _ in (0, 1))


def test_local_time_zone_does_not_matter(spark):
    _, sales, _ = shop(np.random.default_rng(5), 30, [1, 2])
    c, x = spark.createDataFrame([], CLICKS), spark.createDataFrame([], LINES)
    run = lambda: sorted(map(tuple, point_in_time.feature_table(c, spark.createDataFrame(sales, SALES), x).collect()), key=repr)
    utc = run()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_blocks_hand_on_what_is_open():
    rng = np.random.default_rng(6)
    n = 400
    client, time = np.sort(rng.integers(0, 5, n)), rng.integers(0, 50, n)
    what = rng.choice([1, 2, 3, 4 + 3, 8 + 1, 12 + 2, 16, point_in_time.PROBE], n)
    order = np.lexsort((what, time, client))
    client, time, what = client[order], time[order], what[order]
    v = [rng.integers(-3, 9, n) for _ in range(5)]
    _, total, latest, left = point_in_time._features(client, time, what, *v, None)
    for _ in range(20):
        cuts = [0, *sorted(rng.choice(np.arange(1, n), 7, replace=False).tolist()), n]
        carry, totals, at, ident = None, [], [], []
        for a, b in zip(cuts, cuts[1:]):
            _, t, last, carry = point_in_time._features(client[a:b], time[a:b], what[a:b], *(x[a:b] for x in v), carry)
            totals.append(t)
            at.append(last[0])
            ident.append(last[1])
        assert (np.concatenate(totals, axis=1) == total).all()
        assert (np.concatenate(at) == latest[0]).all() and (np.concatenate(ident) == latest[1]).all()
        assert carry[0] == left[0] and (carry[1] == left[1]).all() and carry[2] == left[2]


# ---- op12 ----------------------------------------------------------------------------------------------------------

HARD = ["a", "b", " ", "  ", "\n", "'", "'ll", "'re", "1", "2", "é", "中", "\x85", " ", "\xa0", "\U000105c0", "࢏", "!", "ǅ", "\U0001f600", "\x1c", "<|endoftext|>", "́", "S", "ſ", "\r\n", "\t"]


@pytest.mark.parametrize("step,overlap", [(byte_bpe.STEP, byte_bpe.OVERLAP), (7, 5), (16, 9), (1, 4)])
def test_chunks_meet_and_encode_as_the_library(step, overlap):
    file, rng = rank_file(), random.Random(step)
    own, want = byte_bpe.coder(file), library(file)
    for _ in range(1500):
        text = "".join(rng.choice(HARD) for _ in range(rng.randint(0, 60)))
        ids = own.encode(text, step, overlap)
        assert list(ids) == want.encode_ordinary(text), (text, step, overlap)
        assert own.decode(ids) == text.encode()


def test_long_runs_round_trip():
    own = byte_bpe.coder(rank_file())
    for text in (" " * 500_000 + "x", "a" * 500_000, "中" * 300_000, "ab " * 200_000 + " " * 300_000, ("x" * 1000 + " ") * 500):
        assert own.decode(own.encode(text)) == text.encode()


def test_encode_rows(spark):
    file = rank_file()
    want = library(file)
    long = ("Some text, 12 words' length; \n  " * 12_000)[:300_001]
    texts = [(1, "a b"), (1, "a b"), (2, None), (None, "null id"), (3, ""), (4, long), (5, long), (4, long + "x"), (6, "z" * 300_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS _text", "3 AS no")
    rows = byte_bpe.encode(docs, file).collect()
    key = lambda r: (r[0] is None, r[0] or 0, len(r[1]))
    ids = lambda t: want.encode_ordinary(t) if len(t) < 300_000 or " " in t else list(byte_bpe.coder(file).encode(t))
    assert sorted([(r.doc_id, r.ids) for r in rows], key=key) == sorted([(d, ids(t or "")) for d, t in texts], key=key)
    back = byte_bpe.decode(byte_bpe.encode(docs, file), file).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, bytes(r.decoded))) for r in back) == sorted((d is None, d or 0, (t or "").encode()) for d, t in texts)
    assert byte_bpe.digests(docs.limit(0), file).collect() == []


def test_op12_whole_table_against_the_library(spark):
    import pyarrow.parquet as pq

    want, docs = library(rank_file()), pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for d, t in zip(docs["doc_id"], docs["text"]):
        ids = want.encode_ordinary(t or "")
        expected.append((d, len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode())))
    assert sorted(map(tuple, queries.op12_byte_bpe(spark, FOLDER).collect())) == sorted(expected)


# ---- op13 ----------------------------------------------------------------------------------------------------------


def grams(text, longest):
    import re

    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(ws), [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]


@pytest.mark.parametrize("longest,size", [(1, 10_000), (2, 97), (3, 10_000)])
def test_resampling_against_a_plain_form(spark, longest, size):
    rng = random.Random(longest)
    words = ["Alpha", "beta", "GAMMA", "é", "中文", "x1", "9", "to-do", "İ", "\x7f"]
    docs = [(rng.choice([1, 2, 3, None, k]), None if k % 17 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    target = [("beta gamma beta",), (None,), ("x1 é 中文",)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "5 AS weight", "6 AS rank"), spark.createDataFrame(target, "text string")
    got = importance.resample(d, t, longest=longest, size=size)
    bucket = lambda f: zlib.crc32(f.encode()) % size
    s, tt = Counter(bucket(f) for _, x in docs for f in grams(x, longest)[1]), Counter(bucket(f) for (x,) in target for f in grams(x, longest)[1])
    gain = [math.floor(1000 * math.log((tt[b] + 1.0) * (s.total() + size) / ((s[b] + 1.0) * (tt.total() + size)))) for b in range(size)]
    want = []
    for k, x in docs:
        n, fs = grams(x, longest)
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(f)] for f in fs)
        want.append([k, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = {id(r): i + 1 for i, r in enumerate(fit[: 10 * len(fit) // 100])}
    every = sorted((tuple(r) + (drawn.get(id(r)),) for r in want), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == every and drawn


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    assert [r.rank for r in importance.resample(some, none).collect()] == [None]
