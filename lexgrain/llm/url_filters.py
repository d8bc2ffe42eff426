"""URL filters by a sort-merge range join (DataFrame functions only).

A rule (host, path) becomes the key ``reversed host + "." + U+0001 + path``; every URL it covers has, for one of the suffixes of
its host, a key that starts with the rule's, so the rule is the interval of keys with that prefix and rules are nested or
disjoint. URL keys and rules are sorted together. A rule carries the stack of rules that are open where it starts; the sweep
hands the last rule's stack to each URL key, which pops the rules that closed before it. The deepest one left is the longest
rule of that host suffix, and the longest over a URL's suffixes wins.

The rules that enclose a rule are those whose path is a prefix of its own: a join of its path's prefixes, as long as some rule's
path, with the rules themselves. A stack is no longer than the rule's path, and the work grows with the rules, not with
their square, however many of them one host has.

The sweep runs in salted groups of URLs. Each group gets all rules by the shuffle (rules x salts rows; nothing is broadcast),
so a host, or one URL, that holds most rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\u0001"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// (ASCII lower case) and the path up to ? or #; both empty for null or no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("." + MARK), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): per rule the open rules where it starts, itself last. Rules with a null or empty host are ignored.

    A rule given twice counts once; if its verdicts differ, ``block`` wins.
    """
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce(F.col("path"), F.lit(""))
    one = (
        rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isNotNull())
        .groupBy(host.alias("host"), path.alias("path"))
        .agg(F.max("verdict").alias("verdict"))
    )
    sizes = [r[0] for r in one.select(F.length("path")).distinct().collect()]  # as many as the longest path has characters at most
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sorted(sizes))).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    inner = one.select("host", F.col("path").alias("inner"), F.explode(prefixes).alias("path"))
    outer = F.struct(
        F.length("path").alias("depth"),
        _key(_labels(F.col("host")), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"),
        F.length(F.concat("host", "path")).alias("size"),
        F.length("host").alias("host_size"),
        "verdict",
    )
    return (
        inner.join(one, ["host", "path"])
        .groupBy("host", "inner")
        .agg(F.array_sort(F.collect_list(outer)).alias("stack"))
        .select(_key(_labels(F.col("host")), F.col("inner")).alias("key"), "stack")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule (null if none fits), verdict (the rule's, else ``default``).

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the URL's path starts with the
    rule's; the longest host + path wins, then the longest host. Null, empty and odd URLs get ``default``. Repeated rows
    give repeated results; other columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    host, path = host_and_path(F.col("u"))
    urls = (
        pages.select(F.col(key).alias("k"), F.col(url).alias("u"))
        .withColumn("uid", F.monotonically_increasing_id())
        .select("k", "uid", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int").alias("salt"))
    )
    labels = _labels(F.col("host"))
    upto = F.least(F.size(labels), F.lit(depth))
    keys = F.when(
        (F.col("host") != "") & (upto > 0),
        F.transform(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: _key(F.slice(labels, 1, i), F.col("path"))),
    )
    points = urls.select("salt", F.explode_outer(keys).alias("key"), F.lit(1).alias("kind"), "uid", "k", "host", "path")
    stacks = rule_stacks(rules)
    kind = stacks.schema["stack"].dataType
    marks = stacks.select(
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("uid"), F.lit(None).cast(pages.schema[key].dataType).alias("k"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack",
    )
    order = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.unionByName(points.withColumn("stack", F.lit(None).cast(kind))).withColumn("open", F.last("stack", ignorenulls=True).over(order))
    fits = F.filter(F.col("open"), lambda s: F.startswith(F.col("key"), s["key"]))
    best = F.try_element_at(fits, F.lit(-1))
    found = (
        swept.where(F.col("kind") == 1)
        .withColumn("best", best)
        .groupBy("salt", "uid")
        .agg(
            F.any_value("k").alias("k"), F.any_value("host").alias("host"), F.any_value("path").alias("path"),
            F.max(F.when(F.col("best").isNotNull(), F.struct("best.size", "best.host_size", "best.rule", "best.verdict"))).alias("win"),
        )
    )
    return found.select(
        F.col("k").alias(key), "host", "path", F.col("win.rule").alias("rule"), F.coalesce("win.verdict", F.lit(default)).alias("verdict")
    )
