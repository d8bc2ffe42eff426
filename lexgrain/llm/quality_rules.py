"""Quality rules: a decision list learned by sequential covering, applied as Spark conditional expressions.

Features come from one pass over the whole texts. The learner takes a bounded sample of labelled rows and grows conjunctions of
thresholds that cover low-quality rows by information gain, prunes each on rows held back from its growth, keeps those that
stay precise there, and removes what they cover. The rules are emitted in order as one conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import bounded_sample, map_batches

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "mean_word_chars": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "lines_per_word": ("n_lines", "n_words"),
}
#: Labelled rows that the learner takes at most, in the order of a hash of their id.
SAMPLE_ROWS = 50_000


def features(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for a whole text; all 0 for null and empty ones."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.int64, count=n)
    repeated = 0
    if n >= 4:
        pairs = np.unique(ids[:-1] * len(code) + ids[1:], return_inverse=True)[1]
        _, inverse, counts = np.unique(pairs[:-1] * len(code) + ids[2:], return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        mask = np.zeros(n, dtype=bool)
        for i in range(3):
            mask[i : n - 2 + i] |= again
        repeated = int(mask.sum())
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    b = np.frombuffer(raw, dtype=np.uint8)
    return (
        n,
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        int(((b >= 65) & (b <= 90)).sum()),
        int(((b >= 48) & (b <= 57)).sum()),
        text.count("!") + text.count("?"),
    )


def with_features(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(__row, counts of COUNTS): the columns ``carry`` of each row (by default all) as one struct, so that no names clash."""
    carry = docs.columns if carry is None else carry
    src = docs.select(F.col(f"`{text}`").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([features(t) for t in batch.column(0).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(found[:, k]) for k in range(len(COUNTS))]], names=["__row", *COUNTS])

    row = src.schema["__row"].dataType.simpleString()
    return map_batches(src, run, f"__row {row}, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """All conditions (ratio, above, threshold) hold: the row is of low quality."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[f] > t if above else x[f] <= t for f, above, t in self.conditions])


def ratios(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {r: x[a] / np.maximum(x[b], 1) for r, (a, b) in RATIOS.items()}


def _thresholds(v: np.ndarray, most: int = 40) -> np.ndarray:
    u = np.unique(v)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= most else np.unique(np.quantile(mid, np.linspace(0, 1, most)))


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, max_rules: int = 12, max_conditions: int = 4, min_cover: int = 5, min_precision: float = 0.95) -> list[Rule]:
    """Sequential covering: grow on the rows outside ``prune``, prune and accept on those inside."""
    left, rules = np.ones(len(bad), dtype=bool), []
    score = lambda rule, at: (int((bad & at & rule.holds(x)).sum()), int((~bad & at & rule.holds(x)).sum()))
    while len(rules) < max_rules and (bad & left & ~prune).sum() >= min_cover:
        grow, conditions = left & ~prune, []
        covered = grow.copy()
        while len(conditions) < max_conditions and (~bad & covered).any():
            p0, n0 = (bad & covered).sum(), (~bad & covered).sum()
            base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
            for f, v in x.items():
                for t in _thresholds(v[covered]):
                    high = v > t
                    for above in (True, False):
                        now = covered & (high if above else ~high)
                        p, n = (bad & now).sum(), (~bad & now).sum()
                        if p >= min_cover and (gain := p * (np.log2(p / (p + n)) - base)) > best[0] + 1e-9:
                            best = (gain, (f, above, float(t)))
            if best[1] is None:
                break
            conditions.append(best[1])
            covered &= Rule((best[1],)).holds(x)
        if not conditions:
            break
        held = left & prune

        def worth(rule: Rule, at: np.ndarray = held) -> float:
            p, n = score(rule, at)
            return (p - n) / max(p + n, 1)

        rule = max((Rule(tuple(conditions[:k])) for k in range(1, len(conditions) + 1)), key=lambda r: (worth(r), -len(r.conditions)))
        p, n = score(rule, left)
        hp, hn = score(rule, held)
        if p < min_cover or p / (p + n) < min_precision or hp + hn and hp / (hp + hn) < min_precision:
            break
        rules.append(rule)
        left &= ~rule.holds(x)
    return rules


def fit(featured: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", sample: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from the labelled rows that pass the base rules; ``featured`` has ``key`` and COUNTS.

    Of several labels of one id the lowest counts; null labels and ids are left out. Without labels there are no rules.
    """
    one = labels.select(F.col(key).alias("__id"), F.col(quality).alias("__q")).dropna().groupBy("__id").agg(F.min("__q").alias("__q"))
    rated = featured.where(~base_failed()).join(one, F.col(key) == F.col("__id")).select("__id", "__q", *COUNTS)
    rows = bounded_sample(rated, sample, "__id", *COUNTS).toPandas()
    if rows.empty:
        return []
    x = ratios({c: rows[c].to_numpy(dtype=float) for c in COUNTS})
    return learn(x, rows["__q"].to_numpy() == 0, np.arange(len(rows)) % 3 == 2)


def base_failed() -> Column:
    """Under 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The ordered rules as one conditional expression: false where one holds, else true."""
    value = lambda f: F.col(RATIOS[f][0]) / F.greatest(F.col(RATIOS[f][1]), F.lit(1))
    out = None
    for rule in rules:
        test = F.lit(True)
        for f, above, t in rule.conditions:
            test = test & (value(f) > t if above else value(f) <= t)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(featured: DataFrame, rules: list[Rule]) -> DataFrame:
    """``featured`` with base_failed and kept (false if base_failed, else the decision list's verdict)."""
    return featured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept_rows(featured: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of :func:`with_features`, as they were, that pass the base rules and the decision list."""
    return judge(featured, rules).where("kept").select("__row.*")


def keep(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base rules and the decision list."""
    return kept_rows(with_features(docs, text), rules)
