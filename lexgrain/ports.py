"""Interfaces to model and fetch services, with deterministic offline stand-ins."""

from __future__ import annotations

import time
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashedEmbedder:
    """Unit vectors of hashed words: equal texts have equal vectors, texts with common words are near."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = xxhash.xxh3_64_intdigest(word)
                row[h % self.dimensions] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).tolist()


#: Letters that LetterEmbedder counts.
LETTERS = "aeinorst"


class LetterEmbedder:
    """How often each of LETTERS occurs, either case: a stand-in whose vectors can be computed anywhere."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(c)) for c in LETTERS] for t in map(str.lower, texts)]


class RetryingEmbedder:
    """Calls another embedder again after a failure, waiting longer each time; the last failure is raised."""

    def __init__(self, inner: Embedder, attempts: int = 5, wait_seconds: float = 2.0):
        self.inner, self.attempts, self.wait_seconds = inner, attempts, wait_seconds

    def embed(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(1, self.attempts + 1):
            try:
                return self.inner.embed(texts)
            except Exception:
                if attempt == self.attempts:
                    raise
                time.sleep(self.wait_seconds * attempt)
        return []


def without_embedding(paragraphs: DataFrame, year: int | None = None) -> DataFrame:
    """Rows whose embedding is missing, of one year's decisions if given (a prefix filter that reaches the scan)."""
    out = paragraphs.where(F.col("embedding").isNull())
    return out if year is None else out.where(F.col("celex").startswith(f"6{year}CJ"))


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 300, most: int = 8000) -> DataFrame:
    """(key, embedding) of texts cut to ``most`` characters, in batches; a task retry repeats only its own."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            vectors = [v for i in range(0, len(texts), batch) for v in embedder.embed(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "embedding"])

    return rows.select(key, F.substring(F.coalesce(text, F.lit("")), 1, most).alias("t")).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


class Rewriter(Protocol):
    def rewrite(self, context: str, question: str) -> str: ...


class LastLineRewriter:
    """Puts the last line of the conversation before the question: a stand-in that shows what a service would be given."""

    def rewrite(self, context: str, question: str) -> str:
        return f"{context.rpartition(chr(10))[2]} | {question}" if context else question


def rewrite(questions: DataFrame, rewriter: Rewriter | None = None, key: str = "conv_id", context: str = "context", question: str = "question") -> DataFrame:
    """(key, question) made standalone from the conversation so far; without a service, or an answer, the question as it is."""
    if rewriter is None:
        return questions.select(key, question)

    def run(batches):
        for b in batches:
            out = [(rewriter.rewrite(c or "", q or "") or "").strip() or q for c, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, question])

    return questions.select(key, context, question).mapInArrow(run, f"`{key}` {questions.schema[key].dataType.simpleString()}, `{question}` string")


#: Kinds of content that are asked for in turn.
ACCEPT = ("application/xhtml+xml", "text/html")


class Fetcher(Protocol):
    def get(self, key: str, accept: str) -> tuple[int, str]:
        """(HTTP status, body)."""


def fetch(wanted: DataFrame, fetcher: Fetcher, key: str = "key", accept: tuple[str, ...] = ACCEPT) -> DataFrame:
    """(key, content): the first kind of content that is not empty. 404 and 406 count as empty, other errors end the task."""

    def one(k: str) -> str:
        for kind in accept:
            status, body = fetcher.get(k, kind)
            if status not in (200, 404, 406):
                raise OSError(f"status {status} for {k}")
            if status == 200 and body.strip():
                return body
        return ""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(str(k)) for k in b.column(0).to_pylist()], pa.string())], names=[key, "content"])

    return wanted.select(key).mapInArrow(run, f"`{key}` {wanted.schema[key].dataType.simpleString()}, content string")


def expand(questions: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """(question, variant): the given variants, the question itself where there are none."""
    own = questions.select(F.col("qid").alias("question"), F.col("text").alias("variant"))
    if variants is None:
        return own
    missing = own.join(variants.select("question").distinct(), "question", "left_anti")
    return variants.select("question", "variant").unionByName(missing)
