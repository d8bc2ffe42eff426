"""Resampling a corpus towards a target distribution by hashed n-gram importance weights.

Features are hashed into a fixed number of buckets. Their totals in corpus and target give each bucket an integer gain. Scoring
explodes nothing: higher-order functions make the array of a text's buckets and add up the gains at its entries, which are one
literal array of as many entries as there are buckets. Only the totals are shuffled, at most one row a bucket and task; the texts
never are. Gumbel noise from a hash of the document's id makes the highest scores a sample without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored
from ..plans.order import numbered

BUCKETS = 10_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, after A-Z are lower-cased; none of a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _runs(found: Column, length: int) -> Callable[[Column], Column]:
    return lambda start: F.array_join(F.slice(found, start, length), " ")


def features(found: Column, longest: int = 1) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by a space, repeats included."""
    runs = [found]
    for k in range(2, longest + 1):
        last = F.size(found) - (k - 1)
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, _runs(found, k)))
    return F.concat(*runs) if longest > 1 else found


def buckets(found: Column, size: int = BUCKETS) -> Column:
    return F.transform(found, lambda f: F.pmod(F.crc32(f.cast("binary")), F.lit(size)).cast("int"))


def totals(texts: DataFrame, text: str = "text", longest: int = 1, size: int = BUCKETS) -> dict[int, int]:
    """Features by bucket over all texts: summed in the tasks first, so at most ``size`` rows of a task are shuffled, and collected."""
    each = texts.select(F.explode(buckets(features(words(F.col(text)), longest), size)).alias("bucket"))
    return {r.bucket: r["count"] for r in each.groupBy("bucket").count().collect()}


def gains(corpus: dict[int, int], target: dict[int, int], size: int = BUCKETS) -> list[int]:
    """Per bucket floor(1000 ln) of the target's share over the corpus's, each count raised by one."""
    s, t = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (s + size) / ((corpus.get(b, 0) + 1.0) * (t + size)))) for b in range(size)]


def scored(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", longest: int = 1, seed: str = "2024") -> DataFrame:
    """(key, n_words, n_features, weight, score): weight is the sum of a text's gains, score adds the noise of its key.

    A null or empty text has no features and weight 0; a null key's noise is that of an empty one.
    """
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    found = docs.select(key, words(F.col(text)).alias("_words")).withColumn("_buckets", buckets(features(F.col("_words"), longest), len(gain)))
    weight = F.aggregate("_buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    out = found.select(key, F.size("_words").cast("long").alias("n_words"), F.size("_buckets").cast("long").alias("n_features"), weight.alias("weight"), noise.alias("_noise"))
    return out.select(key, "n_words", "n_features", "weight", (F.col("weight") + F.col("_noise")).cast("long").alias("score"))


def draw(rows: DataFrame, percent: int = 10, least_words: int = 20, key: str = "doc_id") -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3... for the floor(percent * N / 100) highest scores of the N rows with ``least_words`` words.

    Ties go to the smaller key; other rows have no rank. The order is one of ranges of scores, no task sees all rows.
    """
    kept = stored(rows, "scores")
    fit = F.col("n_words") >= least_words
    ordered = numbered(kept.where(fit), F.col("score").desc(), F.col(key).asc(), name="_place")
    most = percent * kept.where(fit).count() // 100
    rank = F.when(F.col("_place") <= most, F.col("_place"))
    return ordered.withColumn("rank", rank).drop("_place").unionByName(kept.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, size: int = BUCKETS, key: str = "doc_id", text: str = "text", seed: str = "2024") -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of ``docs``; ``target`` needs a column ``text`` of the same name.

    Repeated rows count and are drawn each by itself; other columns are not read; empty tables give no rows, an empty target
    gives gains against a flat one.
    """
    gain = gains(totals(docs, text, longest, size), totals(target, text, longest, size), size)
    return draw(scored(docs, gain, key, text, longest, seed), percent, least_words, key)
