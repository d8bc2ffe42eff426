"""Best-two-fit packing of tokenized documents into sequences of fixed capacity.

Only lengths decide a packing, so it is planned on the histogram of piece lengths (at most ``capacity`` entries, for any
corpus): fill a bin with the longest lengths that fit, then replace its smallest with two unpacked lengths that fill the
expanded gap more tightly; the bin is repeated for as long as the counts allow. Pieces then take the plan's places by their rank
among the pieces of their length, which comes from per-task counts and running sums: no sort of all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import stored
from .batches import bounded
from .bpe import Encoder, id_encoder
from .token_counts import Vocabulary

CAPACITY, END = 1024, 2
_ENCODERS: dict[Vocabulary, Encoder] = {}


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole capacities but for the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best two fit: (how often, {length: pieces}) for each kind of bin; every piece is in one bin."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[int, dict[int, int]]] = []

    def largest(most: int) -> int:
        at = np.flatnonzero(left[1 : most + 1] > 0)
        return int(at[-1]) + 1 if len(at) else 0

    while left.any():
        items: list[int] = []
        gap = capacity
        while gap and (k := largest(gap)):
            items.append(k)
            left[k] -= 1
            gap -= k
        if gap and len(items) > 1:
            small = items[-1]
            room, best = gap + small, (small, 0, 0)
            lengths = np.flatnonzero(left[: room + 1] > 0)
            i, j = 0, len(lengths) - 1
            while i <= j and best[0] < room:
                u, v = int(lengths[i]), int(lengths[j])
                if u + v > room:
                    j -= 1
                    continue
                if u + v > best[0] and (u != v or left[u] > 1):
                    best = (u + v, u, v)
                if i == j:
                    break
                if u + v <= room and left[u] > 1 and 2 * u > best[0] and 2 * u <= room:
                    best = (2 * u, u, u)
                i += 1
            if best[1]:
                items.pop()
                left[small] += 1
                for k in best[1:]:
                    left[k] -= 1
                    items.append(k)
        use: dict[int, int] = {}
        for k in items:
            use[k] = use.get(k, 0) + 1
        more = min(int(left[k]) // n for k, n in use.items())
        for k, n in use.items():
            left[k] -= more * n
        out.append((1 + more, use))
    return out


def places(bins: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, per bin, first sequence, offset): where the pieces of a length go by their rank."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for times, use in bins:
        offset = 0
        for length, n in use.items():
            start = taken.get(length, 0)
            taken[length] = start + times * n
            out.append((length, start, start + times * n, n, sequence, offset))
            offset += length * n
        sequence += times
    return out


def pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, end: int | None = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, task, rank): the pieces of every document, ranked among their length in their task."""
    tail = b"" if end is None else np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = id_encoder(vocabulary.json_path, vocabulary.ranks_path, vocabulary.pattern)
        values, task, seen = _ENCODERS[vocabulary].values, TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = b"".join(values(t or "")) + tail
                for p, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((i, p, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
            a = np.array(rows, dtype=np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(a[0])), pa.array(a[1].astype(np.int32)), *[pa.array(c) for c in a[2:5]], pa.array(np.full(a.shape[1], task, dtype=np.int32)), pa.array(a[5])],
                names=[key, "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    bounded(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, end: int | None = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty: with ``end`` they are one piece of one id. Documents over ``capacity`` are cut, the first piece
    may be shorter. Repeated rows are packed each; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary, capacity, end, key, text).where("length > 0"), "pieces")
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = per_task.select(
        "task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before")
    )
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = spark.createDataFrame(places(plan(histogram, capacity)), "length long, lo long, hi long, per long, sequence long, at long")
    ranked = cut.join(before, ["task", "length"]).withColumn("g", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(slots), "length").where((F.col("g") >= F.col("lo")) & (F.col("g") < F.col("hi")))
    within = F.col("g") - F.col("lo")
    return placed.select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(within / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(within, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )
