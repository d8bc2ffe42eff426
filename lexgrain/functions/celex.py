"""Decision identifiers: building, classifying, and typing references to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relation types with their cue phrases, most specific first.
RELATION_CUES: dict[str, list[str]] = {
    "distinguishing": ["unlike in", "in contrast", "must be distinguished", "cannot be transposed", "differs from", "distinguished from"],
    "by_analogy": ["by analogy", "mutatis mutandis", "applied by analogy"],
    "following": [
        "settled case-law", "settled case law", "consistently held", "has already held", "has also held", "the court has held",
        "as the court held", "as the court ruled", "the court ruled", "in accordance with the judgment", "it is settled",
        "it is also settled", "the court has consistently", "as the court has held",
    ],
    "see": ["see, in particular", "see to that effect", "see also", "(see", "see "],
}
_CUES = [(name, p) for name, phrases in RELATION_CUES.items() for p in phrases]
# Id suffixes of documents that belong to a decision, and their kinds.
KINDS = {"_SUM": "summary", "_RES": "resolution", "_INF": "info"}
#: Two-digit years from here on are of the 1900s.
PIVOT = 53


def full_year(yr: Column) -> Column:
    y = yr.cast("int")
    return F.when(y >= 100, y).when(y >= PIVOT, y + 1900).otherwise(y + 2000)


def candidate(registry: Column, number: Column, yr: Column) -> Column:
    """6 + year + court + number: T and F have their own courts, all others (null included) are CJ."""
    court = F.when(registry == "T", "TJ").when(registry == "F", "FJ").otherwise("CJ")
    digits = number.cast("int").cast("string")
    return F.concat(F.lit("6"), F.lpad(full_year(yr).cast("string"), 4, "0"), court, F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))


def classify(celex: Column) -> tuple[Column, Column]:
    """(base id, kind): kind by suffix, judgment where there is none."""
    pattern = f"({'|'.join(KINDS)})$"
    kind = F.lit("judgment")
    for suffix, name in KINDS.items():
        kind = F.when(celex.endswith(suffix), name).otherwise(kind)
    return F.regexp_replace(celex, pattern, ""), kind


def is_judgment_text(celex: Column) -> Column:
    return ~celex.rlike(f"({'|'.join(KINDS)})$")


def relation(window: Column) -> tuple[Column, Column]:
    """(relation type, cue) of the first cue, in the order of RELATION_CUES, found in a text window; else cites and null."""
    return named(first_cue(F.lower(window)))


def first_cue(low: Column) -> Column:
    """The number, from 1, of the first cue in the order of RELATION_CUES in a lower-cased window, or null."""
    (_, first), *rest = _CUES
    return reduce(lambda c, k: c.when(low.contains(rest[k][1]), k + 2), range(len(rest)), F.when(low.contains(first), 1))


def named(cue: Column) -> tuple[Column, Column]:
    """(relation type, cue) of a cue's number: cites and null where it is null."""
    kinds, phrases = (F.array(*map(F.lit, x)) for x in zip(*((name, p.strip()) for name, p in _CUES), strict=True))
    return F.when(cue.isNull(), "cites").otherwise(F.element_at(kinds, cue)), F.when(cue.isNotNull(), F.element_at(phrases, cue))


def pinpoint(text: Column) -> Column:
    """The first paragraph number named in the next 160 characters, or null."""
    return F.expr("try_cast(null as int)") if text is None else F.nullif(F.regexp_extract(F.substring(text, 1, 160), r"(?iU)\bparagraphs?\s+(\d+)", 1), F.lit("")).try_cast("int")


def confidence(resolved: Column, has_pinpoint: Column, typed: Column) -> Column:
    """0.5, +0.3 resolved, +0.1 with a paragraph, +0.1 with a typed relation, at most 1."""
    flag = lambda c, v: F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(0.5) + flag(resolved, 0.3) + flag(has_pinpoint, 0.1) + flag(typed, 0.1), F.lit(1.0)), 2).cast("float")


def decision_year(celex: Column) -> Column:
    return F.substring(celex, 2, 4)


def document_url(celex: Column) -> Column:
    return F.concat(F.lit("https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"), celex)
