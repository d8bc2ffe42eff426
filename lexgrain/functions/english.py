"""English lexemes: a typed tokenizer of column functions and the Snowball English stemmer (the published "Porter 2" algorithm).

The stemmer is Python; it sees each distinct word of a batch once (:func:`stem`), or each distinct word of a table (:func:`stem_table`).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

# Fixed values of the published algorithm: words with stems of their own, words that stay or stop early, beginnings that
# set the first region, endings and what takes their place (steps 2, 3 and 4).
IRREGULAR = "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl"
UNCHANGED = "sky news howe atlas cosmos bias andes"
DONE_AFTER_PLURAL = "inning outing canning herring earring proceed exceed succeed"
BEGINNINGS = "gener commun arsen"
STEP2 = (
    "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful "
    "ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:"
)
STEP3 = "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:"
STEP4 = "al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ism: ate: iti: ous: ive: ize: ion:"
LI = "cdeghkmnrt"


def endings(rules: str) -> list[tuple[str, str]]:
    """(ending, replacement), the longest first."""
    return sorted((tuple(r.split(":")) for r in rules.split()), key=lambda r: (-len(r[0]), r[0]))


_IRREGULAR = dict(r.split(":") for r in IRREGULAR.split()) | {w: w for w in UNCHANGED.split()}
_DONE = frozenset(DONE_AFTER_PLURAL.split())
_STEPS = [endings(r) for r in (STEP2, STEP3, STEP4)]
_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
_FIRST = re.compile(f"{'|'.join(BEGINNINGS.split())}|{_REGION.pattern}")
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile("[aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    first = _FIRST.match(word)
    if first is None:
        return len(word), len(word)
    second = _REGION.match(word, first.end())
    return first.end(), second.end() if second else len(word)


def _replaced(word: str, rules: list[tuple[str, str]], start: int, allowed) -> str:
    """The longest ending that fits, replaced if it lies beyond ``start`` and is allowed."""
    for end, new in rules:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + new if len(stem) >= start and allowed(end, stem) else word
    return word


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    end = re.search("(?:eedly|ingly|edly|eed|ing|ed)$", word)
    if end is None:
        return word
    stem = word[: end.start()]
    if end[0].startswith("ee"):
        return stem + "ee" if len(stem) >= r1 else word
    if not _VOWEL.search(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", stem):
        return stem[:-1]
    return stem + "e" if r1 >= len(stem) and _SHORT.search(stem) else stem


@lru_cache(maxsize=100_000)
def snowball(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    word = re.sub("('s'|'s|')$", "", word.removeprefix("'"))
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    word = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    r1, r2 = _regions(word)
    word = _plural(word)
    if word in _DONE:
        return word
    word = _past(word, r1)
    word = re.sub("(.[^aeiouy])[yY]$", r"\1i", word)
    word = _replaced(word, _STEPS[0], r1, lambda end, stem: stem.endswith("l") if end == "ogi" else stem[-1:] in LI and bool(stem) if end == "li" else True)
    word = _replaced(word, _STEPS[1], r1, lambda end, stem: end != "ative" or len(stem) >= r2)
    word = _replaced(word, _STEPS[2], r2, lambda end, stem: end != "ion" or stem.endswith(("s", "t")))
    if word.endswith("e"):
        stem = word[:-1]
        if len(stem) >= r2 or len(stem) >= r1 and not _SHORT.search(stem):
            word = stem
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    known = {w: snowball(w) for w in words.dropna().unique()}
    return words.map(known)


#: Stems that a task remembers between batches.
KNOWN = 300_000


def lexeme_arrays(stop: frozenset[str]) -> Callable[[Column], Column]:
    """Arrays of tokens -> arrays of stems, with nulls in the places of stop words. A task stems each distinct token once while it remembers it."""
    known: dict[str, str | None] = {}

    @arrow_udf("array<string>")
    def lexemes(tokens: pa.Array) -> pa.Array:
        every = tokens.flatten().dictionary_encode()
        words = every.dictionary.to_pylist()
        if len(known) > KNOWN:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = None if w is None or w in stop else snowball(w)
        stems = pa.array([known[w] for w in words], pa.string())
        size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, stems.take(every.indices))

    return lexemes


def stem_table(lexemes: DataFrame, lexeme: str = "lexeme") -> DataFrame:
    """(lexeme, stem) of the distinct lexemes: a table to join, or to keep beside an index."""
    return lexemes.select(F.col(lexeme).alias("lexeme")).where("lexeme IS NOT NULL").distinct().withColumn("stem", stem("lexeme"))


# ---- typed tokens --------------------------------------------------------------------------------------------------

_EMAIL = r"[\p{L}\p{N}._+-]+@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"
_HOST = r"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}"
_URL = rf"{_HOST}/[^\s<>\"]*"
_VERSION = r"\p{N}+(?:\.\p{N}+)+"
_HYPHENATED = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)+"
_WORD = r"[\p{L}\p{N}]+"
_TOKEN = "|".join((_EMAIL, _URL, rf"{_HOST}(?![\p{{L}}\p{{N}}])", _VERSION, _HYPHENATED, _WORD))
#: Kinds whose lexemes are stemmed; numbers, mixed words, hosts, addresses and paths stay as they are.
STEMMED = ("word", "compound")


def typed_tokens(text: Column) -> Column:
    """array<struct<kind, token>> of a text in its order: email, url, host, path, number, compound, numword, word.

    A URL is followed by its host and path, a hyphenated compound by its parts; null gives an empty array.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))
    one = lambda kind, token: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), token.alias("token"))
    plain = lambda t: F.when(t.rlike(r"^\p{N}+$"), "number").when(t.rlike(r"\p{N}"), "numword").otherwise("word")

    def each(t: Column) -> Column:
        host = F.regexp_extract(t, "^[^/]+", 0)
        return (
            F.when(t.contains("@"), F.array(one("email", t)))
            .when(t.contains("/"), F.array(one("url", t), one("host", host), one("path", F.regexp_extract(t, "/.*", 0))))
            .when(t.rlike(rf"^(?:{_VERSION})$"), F.array(one("number", t)))
            .when(t.contains("."), F.array(one("host", t)))
            .when(t.contains("-"), F.concat(F.array(one(F.when(t.rlike(r"\p{N}"), "numword").otherwise("compound"), t)), F.transform(F.split(t, "-"), lambda p: one(plain(p), p))))
            .otherwise(F.array(one(plain(t), t)))
        )

    return F.flatten(F.transform(found, each))


def lexemes(docs: DataFrame, key: str, text: str, stop: frozenset[str]) -> DataFrame:
    """(key, pos, kind, lexeme): typed tokens at their positions, words stemmed, stop words left out but counted in the positions."""
    each = docs.select(key, F.posexplode(typed_tokens(F.col(text))).alias("pos", "t")).select(key, (F.col("pos") + 1).alias("pos"), F.col("t.kind").alias("kind"), F.col("t.token").alias("token"))
    own = each.where(~(F.col("kind").isin("word") & F.col("token").isin(*sorted(stop))))
    stemmed = own.where(F.col("kind").isin(*STEMMED)).withColumn("lexeme", stem("token"))
    return stemmed.unionByName(own.where(~F.col("kind").isin(*STEMMED)).withColumn("lexeme", F.col("token"))).select(key, "pos", "kind", "lexeme")
