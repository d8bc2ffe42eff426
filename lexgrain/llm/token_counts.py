"""Token counts from distinct pre-tokens.

The pieces of a pre-token depend on nothing around it. Each document gives a table of its pre-tokens' frequencies; each distinct
pre-token of a batch is counted once by the tokenizer's merges (and kept in a bounded memo), the counts are joined to the
frequencies, and their products are summed per document. Ids are never put together, whatever a text holds.
The join lives in the task that reads the documents, so it needs no shuffle, a pre-token that holds a third of all occurrences
is one dictionary entry, and memory is bounded by the memo and TOGETHER entries of frequency tables.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches
from .bpe import Encoder, piece_counter


@dataclass(frozen=True)
class Vocabulary:
    """Files of one byte-level BPE vocabulary and its pre-tokenizer's pattern."""

    json_path: str
    ranks_path: str
    pattern: str


#: Entries of frequency tables that are joined to counts together.
TOGETHER = 500_000
_COUNTERS: dict[Vocabulary, Encoder] = {}


def _counter(v: Vocabulary) -> Encoder:
    if v not in _COUNTERS:
        _COUNTERS[v] = piece_counter(v.json_path, v.ranks_path, v.pattern)
    return _COUNTERS[v]


def count_texts(texts: list[str | None], v: Vocabulary) -> np.ndarray:
    """Tokens of each text: pre-token frequencies joined to one count per distinct pre-token."""
    enc, out = _counter(v), np.zeros(len(texts), dtype=np.int64)
    pres: list[str] = []
    often: list[int] = []
    owner: list[int] = []
    starts: list[int] = []

    def join() -> None:
        table = pa.array(pres, pa.large_string()).dictionary_encode()
        pieces = np.array([enc.value(p) for p in table.dictionary.to_pylist()], dtype=np.int64)
        out[owner] = np.add.reduceat(pieces[table.indices.to_numpy()] * np.array(often, dtype=np.int64), starts)

    for i, text in enumerate(texts):
        if not text:
            continue
        frequency: Counter[str] = Counter()
        for part in enc.pre_tokens(text):
            frequency.update(part)
        owner.append(i)
        starts.append(len(pres))
        pres += frequency
        often += frequency.values()
        if len(pres) >= TOGETHER:
            join()
            for x in (pres, often, owner, starts):
                x.clear()
    if pres:
        join()
    return out


def token_counts(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Texts of any length are counted whole. Repeated rows give repeated
    results; other columns are not read.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(count_texts(texts, vocabulary))],
            names=[key, "n_bytes", "n_tokens"],
        )

    kind = docs.schema[key].dataType.simpleString()
    counted = map_batches(docs.select(key, text), count, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

