import pytest

from lexgrain.operators import dml, metadata
from lexgrain.sources import readers, writers
from lexgrain.streaming.incremental import windowed_counts


def test_append_new_twice_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    for _ in range(2):
        writers.append_new(df, f"{tmp_path}/t", "id")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_a_published_version_may_read_the_one_before(spark, tmp_path):
    path = f"{tmp_path}/t"
    writers.publish(spark.range(3), path)
    first = readers.published(spark, path)
    for least in (1, 2):
        writers.publish(readers.published(spark, path).where(f"id >= {least}"), path)
        assert readers.published(spark, path).count() == 3 - least
    assert len([x for x in (tmp_path / "t").iterdir() if x.is_dir()]) == 2 and first.columns == ["id"]
    assert writers.current(spark, f"{tmp_path}/none") is None


def test_fetching_stops_at_errors_but_not_at_missing_pages(spark):
    from lexgrain import ports

    class Broken:
        def get(self, key, accept):
            return (500, "") if key == "2" else (404, "")

    keys = spark.createDataFrame([("1",), ("2",)], "key string")
    assert [tuple(r) for r in ports.fetch(keys.where("key = '1'"), Broken()).collect()] == [("1", "")]
    with pytest.raises(Exception, match="status 500"):
        ports.fetch(keys, Broken()).collect()


def test_replace_partitions_leaves_other_sources(spark, tmp_path):
    path = f"{tmp_path}/t"
    shape = "v int, source string"
    writers.replace_partitions(spark.createDataFrame([(1, "text"), (2, "cellar")], shape), path, "source")
    writers.replace_partitions(spark.createDataFrame([(3, "text")], shape), path, "source")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3]


def test_upsert_keeps_first_written_columns(spark):
    shape = "k int, a string, b string"
    out = dml.upsert(spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], shape), spark.createDataFrame([(1, "A", None), (3, "A", "B")], shape), "k", ["b"])
    assert sorted(map(tuple, out.collect())) == [(1, "a", None), (2, "a", "b"), (3, "A", "B")]


def test_jsonl_defaults(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "t"}\n{bad\n{"celex": "c", "paragraphs": ["p"]}\n')
    rows = sorted(readers.jsonl(spark, f"{tmp_path}/x.jsonl").select("celex", "url", "paragraphs").collect())
    assert [tuple(r) for r in rows] == [("c", "", ["p"]), ("unknown", "", [])]


def test_cached_pages_and_fallback(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "b.html").write_text("")
    cached = readers.pages(spark, str(tmp_path))
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = {r.key for r in readers.pending(wanted, cached).collect()}
    assert got <= {"b", "c"} and "c" in got and "a" not in got
    second = spark.createDataFrame([("b", "second")], "key string, content string")
    assert {r.key: r.content for r in readers.prefer(cached, second).collect()} == {"a": "<p>x</p>", "b": "second"}


def test_pivot_drops_self_and_sorts(spark):
    rows = [("x", "title", "t2"), ("x", "title", "t1"), ("x", "cites", "b"), ("x", "cites", "a"), ("x", "cites", "x"), ("x", "cites", "a")]
    out = metadata.pivot(spark.createDataFrame(rows, "entity string, field string, value string"), ["title"], ["cites"], ["cites"]).first()
    assert tuple(out) == ("x", "t1", ["a", "b"])


def test_windowed_counts(spark):
    df = spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'a' as kind union all select timestamp'2024-01-01 00:06:00', 'a'")
    assert windowed_counts(df, "ts", "kind", "5 minutes", "1 hour").count() == 2


def test_retrying_embedder():
    from lexgrain.ports import HashedEmbedder, RetryingEmbedder

    class Flaky:
        calls = 0

        def embed(self, texts):
            self.calls += 1
            if self.calls < 3:
                raise OSError
            return HashedEmbedder(4).embed(texts)

    assert len(RetryingEmbedder(Flaky(), 3, 0.0).embed(["a", "b"])) == 2
    with pytest.raises(OSError):
        RetryingEmbedder(Flaky(), 2, 0.0).embed(["a"])


def test_missing_embeddings_of_a_year(spark):
    from lexgrain.ports import without_embedding

    df = spark.createDataFrame([("61999CJ0001", None), ("61999CJ0002", [1.0]), ("62000CJ0001", None)], "celex string, embedding array<float>")
    assert [r.celex for r in without_embedding(df, 1999).collect()] == ["61999CJ0001"] and without_embedding(df).count() == 2
