"""Full text on token arrays: tokenizer, stemming, boolean web queries, postings and cover-density rank."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .english import stem

# The English stop list that is published with the Snowball stemmers and used by full text in databases.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when "
    "where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
UNIFORM_WEIGHT = 0.1


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))



def postings(docs: DataFrame, key: str, text: str, config: str = "simple") -> DataFrame:
    """(key, lexeme, pos): one row per token, positions from 1. ``english`` leaves stop words out and stems the rest."""
    each = docs.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "lexeme")).withColumn("pos", F.col("pos") + 1)
    if config == "english":
        each = each.where(~F.col("lexeme").isin(*sorted(STOP_WORDS))).withColumn("lexeme", stem("lexeme"))
    return each.select(key, "lexeme", "pos")


def parse_web_query(query: str) -> list[list[tuple[bool, list[str]]]]:
    """OR of ANDs of (wanted, words): quotes make phrases, ``or`` separates, a leading - negates, bare words are ANDed."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not sign:
            groups.append([])
            continue
        words = re.findall(r"[^\W_]+", (phrase or word).lower())
        if words:
            groups[-1].append((not sign, words))
    return [g for g in groups if g]


def matches(query: str, toks: Column) -> Column:
    """Whether a token array satisfies a web query; an empty query matches nothing."""
    text = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    one = lambda words: F.array_contains(toks, words[0]) if len(words) == 1 else text.contains(f" {' '.join(words)} ")
    groups = [reduce(and_, [one(w) if wanted else ~one(w) for wanted, w in g]) for g in parse_web_query(query)]
    return reduce(or_, groups) if groups else F.lit(False)


def matches_all(words: list[str], toks: Column) -> Column:
    return reduce(and_, [F.array_contains(toks, w) for w in words]) if words else F.lit(False)


def cover_density(post: DataFrame, key: str, words: list[str]) -> DataFrame:
    """(key, rank) of the documents that hold all ``words``: each minimal cover counts 0.1 / (1 + words in it that are not asked for).

    A minimal cover starts at the least of the words' last places and ends where that start is first reached; for a single
    word every occurrence is a cover. All of it is window work within a document.
    """
    terms = sorted(set(words))
    asked = post.where(F.col("lexeme").isin(*terms))
    order = Window.partitionBy(key).orderBy("pos")
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("lexeme") == t, F.col("pos")), ignorenulls=True).over(seen).alias(f"_{k}") for k, t in enumerate(terms)]
    ends = asked.select(key, "pos", F.row_number().over(order).alias("nth"), *last).where(reduce(and_, [F.col(f"_{k}").isNotNull() for k in range(len(terms))]))
    ends = ends.withColumn("start", F.least(*[f"_{k}" for k in range(len(terms))]) if len(terms) > 1 else F.col("_0"))
    covers = ends.groupBy(key, "start").agg(F.min("pos").alias("end"), F.min("nth").alias("end_nth"))
    nth = asked.select(key, F.col("pos").alias("start"), F.row_number().over(order).alias("start_nth"))
    noise = (F.col("end") - F.col("start")) - (F.col("end_nth") - F.col("start_nth"))
    return covers.join(nth, [key, "start"]).groupBy(key).agg(F.sum(F.lit(UNIFORM_WEIGHT) / (F.lit(1) + noise)).alias("rank"))
