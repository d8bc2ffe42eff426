"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language and bucket over all training rows (a task sends at most languages x buckets sums). The
log-probability matrix has languages x BUCKETS cells, whatever the corpus size, and goes to the tasks by broadcast. A batch of
texts is a sparse matrix of bucket counts, which is multiplied by the log-probabilities in numpy; a text of any length has
BUCKETS counts at most and is read SLAB characters at a time, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded, map_batches

BUCKETS, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5
UNKNOWN = "und"
#: Characters of a text that are hashed together; parts end before a space where there is one.
SLAB = 1 << 19
#: Cells of the product of counts and log-probabilities that are held at once.
CELLS = 1 << 21
#: Languages whose counts a task holds at once.
HELD = 64
#: How far below what its language's own n-grams score on average a text may lie, per n-gram, besides chance (in deviations). No
#: n-gram counts as less probable than one bucket of all, so that the scale does not change with the size of the corpus.
MARGIN, DEVIATIONS = 1.6, 2.0

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLAB:
        end = text.find(" ", at + SLAB, at + 2 * SLAB)
        end = at + SLAB if end < 0 else end
        yield text[at:end]
        at = end
    yield text[at:]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(bucket, count), in order, of the character n-grams of the whole text, lower-cased, runs of other characters as one
    space, one more at either end; None without a letter."""
    if not text:
        return None
    found: list[tuple[np.ndarray, np.ndarray]] = []
    any_letter = was_letter = False
    carry = np.array([32], dtype=np.uint64)

    def add(new: np.ndarray) -> None:
        nonlocal carry
        code, hashed = np.concatenate([carry, new]), []
        for n in ORDERS:
            m = len(code) - n + 1
            first = max(0, len(carry) - n + 1)  # n-grams that end before the new characters are counted already
            if m <= first:
                continue
            h = np.full(m - first, n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ code[first + i : m + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            if n == 1:
                h = h[code[first:m] != 32]
            hashed.append(h.astype(np.uint16))  # BUCKETS is their range
        if hashed:
            h = np.sort(np.concatenate(hashed), kind="stable")  # a radix sort
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, dtype=np.int64)
            found.append((h[at].astype(np.int64), np.diff(np.append(at, len(h)))))
        carry = code[-(max(ORDERS) - 1) :]

    for part in _parts(text):
        code = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[code]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of a run of other characters stays
        keep[:1] |= was_letter
        any_letter, was_letter = any_letter or bool(letter.any()), bool(letter[-1])
        new = np.where(letter, code, 32)[keep].astype(np.uint64)
        if len(text) <= SLAB:
            new = np.append(new, np.uint64(32))
        add(new)
        if len(found) > 64:
            found = [_merged(found)]
    if not any_letter:
        return None
    if len(text) > SLAB:
        add(np.array([32], dtype=np.uint64))
    return found[0] if len(found) == 1 else _merged(found)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, n in found:
        counts[bucket] += n
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass(frozen=True)
class Verdict:
    language: str
    score: float  # posterior
    fits: bool  # the text's n-grams are about as probable as the language's own


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    matrix: np.ndarray  # buckets x languages, log P(bucket | language)
    prior: np.ndarray

    def scores(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log-likelihoods (texts x languages): the sparse matrix of bucket counts times the log-probabilities."""
        out = np.zeros((len(counted), len(self.languages)))
        if not counted:
            return out
        owner = np.repeat(np.arange(len(counted)), [len(b) for b, _ in counted])
        bucket, often = (np.concatenate([c[k] for c in counted]) for k in range(2))
        step = max(1, CELLS // max(1, len(self.languages)))
        for k in range(0, len(bucket), step):
            own = owner[k : k + step]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[own[starts]] += np.add.reduceat(self.matrix[bucket[k : k + step]].astype(np.float64) * often[k : k + step, None], starts, axis=0)
        return out

    @cached_property
    def usual(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probabilities of one bucket of all at least; their mean and deviation over each language's own n-grams."""
        floored = np.maximum(self.matrix, np.float32(-np.log(BUCKETS)))
        p = np.exp(self.matrix)
        mean = (p * floored).sum(0, dtype=np.float64)
        return floored, mean, np.sqrt(np.maximum((p * floored**2).sum(0, dtype=np.float64) - mean**2, 0))

    def predict(self, texts: list[str | None]) -> list[Verdict]:
        """Per text the most probable language (of equal ones the first by name) and its posterior; und, 0 and False for null,
        no letter, or nothing learned."""
        out = [Verdict(UNKNOWN, 0.0, False)] * len(texts)
        if not self.languages:
            return out
        floored, mean, spread = self.usual
        for lo in range(0, len(texts), 64):
            counted = [(i, c) for i, t in enumerate(texts[lo : lo + 64], lo) if (c := ngram_counts(t)) is not None]
            for (i, (bucket, often)), s in zip(counted, self.scores([c for _, c in counted]), strict=True):
                n, both = int(often.sum()), s + self.prior
                k = int(np.argmax(both))
                least = mean[k] - MARGIN - DEVIATIONS * spread[k] / np.sqrt(n / len(ORDERS))
                out[i] = Verdict(self.languages[k], float(1.0 / np.exp(both - both[k]).sum()), bool(often @ floored[bucket, k] / n >= least))
        return out


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from every row with a non-null language; rows without letters only count for the priors.

    The model takes 256 KB per distinct language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for la, s in sums.items():
                at = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([la] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(s[at], rows[la]))], names=["lang", "bucket", "n"])
            sums.clear()
            rows.clear()

        for batch in batches:
            for t, la in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if la not in sums:
                    if len(sums) == HELD:
                        yield from sent()
                    sums[la], rows[la] = np.zeros(BUCKETS, dtype=np.int64), 0
                rows[la] += 1
                if (c := ngram_counts(t)) is not None:
                    sums[la][c[0]] += c[1]
        yield from sent()

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for la, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(la, np.zeros(BUCKETS + 1, dtype="<i8"))[k] += n  # rows at the end: -1
        for la, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([la]), pa.array([s.tobytes()], pa.binary())], names=["lang", "counts"])

    bounded(train.sparkSession)
    counted = (
        train.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .where(F.col("lang").isNotNull())
        .mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    found = {r["lang"]: np.frombuffer(r["counts"], dtype="<i8") for r in counted.repartition("lang").mapInArrow(dense, "lang string, counts binary").toLocalIterator()}
    languages = tuple(sorted(found))
    matrix, rows = np.zeros((BUCKETS, len(languages)), dtype=np.float32), np.zeros(len(languages))
    for k, la in enumerate(languages):
        grams = found[la][:-1] + SMOOTHING
        matrix[:, k] = np.log(grams / grams.sum())
        rows[k] = found[la][-1]
    prior = np.log(rows + 1) - np.log((rows + 1).sum()) if len(languages) else rows
    return Model(languages, matrix, prior)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score (posterior, 0 to 1).

    Null texts and texts without a letter give ``und`` with score 0; of equally probable languages the first by name is
    given. Whole texts are scored; repeated rows give repeated results; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f.language for f in found], pa.string()), pa.array([f.score for f in found], pa.float64())],
            names=[key, "lang_pred", "score"],
        )

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), score, f"`{key}` {kind}, lang_pred string, score double")


def reject(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is identified with ``min_score`` at least and whose n-grams fit it.

    A posterior compares learned languages with each other only; a text in none of them is known by n-grams that are much
    less probable than the language's own, per n-gram (MARGIN, and DEVIATIONS of chance for short texts).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.predict(batch.column(at).to_pylist())
        return batch.filter(pa.array([f.language != UNKNOWN and f.score >= min_score and f.fits for f in found], pa.bool_()))

    return map_batches(docs.select(*[f"`{n}`" for n in names]), keep, docs.schema)
