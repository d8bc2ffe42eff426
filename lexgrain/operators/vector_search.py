"""Nearest vectors in blocks: packed rows, a matrix product for each pair of blocks, exact scores of what it leaves.

Vectors are packed into blocks of BLOCK_BYTES. A pair of blocks is scored by a matrix product, whose sums may differ from the
exact ones by rounding; everything within SLACK of a question's k-th best of the block is scored again, component by component in
order, and a task passes on the first ranks of each question only. The result does not depend on how rows are dealt to blocks. Vectors that are null, empty,
or hold null or non-finite components, and for the cosine zero ones, have no score: they neither ask nor answer. Vectors of
different dimensions do not meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizes import bounded_bytes

BLOCK_BYTES = 1 << 20
#: Questions that are broadcast, at most.
MOST_BYTES = 64 << 20
#: Scores of a pair of blocks that are held at once.
AT_ONCE = 2_000_000
#: Found rows that a task holds, to pass on only the first of each question.
HELD = 500_000
#: Share of the largest possible score by which a matrix product may differ from the sum in order.
SLACK = 1e-9


def usable(v: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    fine = F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & fine, F.lit(False))


def block_rows(d: int) -> int:
    return max(64, BLOCK_BYTES // (8 * d))


def packed(df: DataFrame, key: str, vector: str, group: str | None = None) -> DataFrame:
    """(part, d, ids, x): the usable vectors of ``df`` in blocks of one dimension and one value of ``group`` (0 without any).

    A task packs its rows in their order, so rows should come sorted by ``group``.
    """
    part = F.col(group).cast("long") if group else F.lit(0).cast("long")
    src = df.where(usable(F.col(vector))).select(part.alias("part"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}  # by dimension
        rows, at = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            for d, (ids, xs) in held.items():
                whole, x = pa.concat_arrays(ids), np.concatenate(xs)
                for k in range(0, len(x), block_rows(d)):
                    some = whole.slice(k, block_rows(d))
                    one = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.concat_arrays([some]))
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([d], pa.int32()), one, pa.array([x[k : k + block_rows(d)].tobytes()], pa.binary())], names=["part", "d", "ids", "x"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            parts, ids, vs = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            size = vs.value_lengths().to_numpy()
            cuts = np.flatnonzero((parts[1:] != parts[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)], strict=True):
                if at is not None and parts[lo] != at:
                    yield from flush()
                    rows = 0
                at = int(parts[lo])
                for d in np.unique(size[lo:hi]).tolist():
                    own = pa.array(lo + np.flatnonzero(size[lo:hi] == d))
                    a, b = held.setdefault(d, ([], []))
                    a.append(ids.take(own))
                    b.append(vs.take(own).flatten().to_numpy().reshape(-1, d))
                rows += hi - lo
                if rows >= block_rows(int(size[lo:hi].max())):
                    yield from flush()
                    rows = 0
        if held:
            yield from flush()

    bounded_bytes(df.sparkSession)
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"part long, d int, ids array<{kind}>, x binary")


def _in_order(a: np.ndarray, b: np.ndarray, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sums of f over the components, added up in their order."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += f(a[:, k], b[:, k])
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * b


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a - b) * (a - b)


def best_pairs(q: np.ndarray, x: np.ndarray, k: int, metric: str, apart: Callable[[int, int], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(question, row, score): for each row of ``q`` at least its k best of ``x``, all ties of the k-th included, with exact scores.

    ``apart(lo, hi)`` marks the pairs of questions lo to hi that may not meet.
    """
    cosine = metric == "cosine"
    q2, x2 = _in_order(q, q, _times), _in_order(x, x, _times)
    q_norm, x_norm = np.sqrt(q2), np.sqrt(x2)
    unit = lambda v, n: v / np.where(n > 0, n, 1)[:, None]
    left, right = (unit(q, q_norm), unit(x, x_norm)) if cosine else (q, x)
    step = max(1, AT_ONCE // len(x))
    for lo in range(0, len(q), step):
        s = left[lo : lo + step] @ right.T
        if cosine:
            s[q_norm[lo : lo + step] == 0] = -np.inf
            s[:, x_norm == 0] = -np.inf
        else:
            s = 2 * s - q2[lo : lo + step, None] - x2[None, :]
        if apart is not None:
            s[apart(lo, lo + len(s))] = -np.inf
        if len(x) > k:
            slack = SLACK if cosine else SLACK * (q2[lo : lo + step] + x2.max())
            least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] - slack
            i, j = np.nonzero((s >= np.broadcast_to(least, len(s))[:, None]) & (s > -np.inf))
        else:
            i, j = np.nonzero(s > -np.inf)
        i += lo
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            yield a, b, _in_order(x[b], q[a], _times) / (x_norm[b] * q_norm[a]) if cosine else _in_order(x[b], q[a], _square)


def first_ranks(found: list[pa.RecordBatch], k: int, metric: str) -> pa.Table:
    """The k best rows of each question among ``found``: the only ones of a task that can be of its k best of all."""
    t = pa.Table.from_batches(found).combine_chunks()
    code = t["qid"].combine_chunks().dictionary_encode(null_encoding="encode").indices
    keys = pa.table({"code": code, "score": t["score"], "id": t["id"]})
    order = pc.sort_indices(keys, sort_keys=[("code", "ascending"), ("score", "descending" if metric == "cosine" else "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()
    of = code.to_numpy()[order]
    start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    rank = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
    return t.take(pa.array(order[rank < k]))


def search(pairs: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(qid, id, score, rank) from pairs of blocks (qids, qd, q, ids, d, x): the k best of each question over all its pairs; ties go to the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for r in range(batch.num_rows):
                d = batch.column(4)[r].as_py()
                if batch.column(1)[r].as_py() != d:
                    continue
                qids, ids = batch.column(0)[r].values, batch.column(3)[r].values
                q, x = (np.frombuffer(batch.column(c)[r].as_buffer()).reshape(-1, d) for c in (2, 5))
                apart = None
                if exclude_self:
                    own, other = qids.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
                    apart = lambda lo, hi, own=own, other=other: own[lo:hi, None] == other[None, :]
                for i, j, score in best_pairs(q, x, k, metric, apart):
                    held.append(pa.RecordBatch.from_arrays([qids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score)], names=["qid", "id", "score"]))
                    rows += len(i)
                    if rows >= HELD:
                        best = first_ranks(held, k, metric)
                        held, rows = best.to_batches(), len(best)
                        if 2 * rows >= HELD:
                            yield from held
                            held, rows = [], 0
        if held:
            yield from first_ranks(held, k, metric).to_batches(max_chunksize=100_000)

    bounded_bytes(pairs.sparkSession)  # a pair is two blocks
    of = lambda c: pairs.schema[c].dataType.elementType.simpleString()
    found = pairs.select("qids", "qd", "q", "ids", "d", "x").mapInArrow(run, f"qid {of('qids')}, id {of('ids')}, score double")
    first = F.col("score").desc() if metric == "cosine" else F.col("score").asc()
    found = found.where(~F.isnan("score"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(first, F.col("id")))).where(F.col("rank") <= k)


def asking(questions: DataFrame, group: str | None = None) -> DataFrame:
    return packed(questions, "qid", "query_vector", group).select(F.col("part").alias("q_part"), F.col("d").alias("qd"), F.col("ids").alias("qids"), F.col("x").alias("q"))


def nearest(corpus: DataFrame, questions: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k nearest of corpus (id, embedding) for questions (qid, query_vector), exact.

    Blocks of questions meet blocks of the corpus where it is read, by a broadcast of MOST_BYTES at most; a larger set of questions
    meets it block by block.
    """
    asked = questions.select("qid", "query_vector")
    n, d = asked.agg(F.count("*"), F.coalesce(F.max(F.size("query_vector")), F.lit(0))).first()
    blocks = F.broadcast(asking(asked.repartition(1))) if 8 * n * d <= MOST_BYTES else asking(asked)
    return search(packed(corpus, "id", "embedding").join(blocks, F.lit(True)), k, metric, exclude_self)


# ---- centroid lists ------------------------------------------------------------------------------------------------

#: Vectors that centroids and probes are fitted on; vectors per list aimed at; lists at most.
SAMPLE, PER_LIST, MOST_LISTS = 20_000, 256, 1024
#: Questions of the sample that set the number of probes, and the share of their nearest that the probes must reach.
TRIALS, REACHED = 512, 0.97
#: Vectors of a list that one task takes.
PER_SLOT = 16_384


@dataclass(frozen=True)
class Lists:
    """Centroids of unit vectors, the lists a question searches, and into how many slots each list is dealt."""

    centroids: np.ndarray
    probes: int
    slots: list[int]

    def order(self, x: np.ndarray) -> np.ndarray:
        """Lists by the distance of their centroids, nearest first."""
        return np.argsort((self.centroids**2).sum(1) - 2 * x @ self.centroids.T, axis=1, kind="stable")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_lists(x: np.ndarray, rows: int, k: int, rounds: int = 12, seed: int = 1, per_list: int = PER_LIST) -> Lists:
    """Lists of about ``per_list`` for ``rows`` vectors from a sample ``x``.

    The probes are the fewest that reach a share of REACHED of the k nearest within the sample. In a table larger than the sample
    the k nearest are nearer, and so in nearer lists.
    """
    rng, x = np.random.default_rng(seed), _unit(x)
    n = int(max(1, min(MOST_LISTS, rows // per_list, len(x) // 16)))
    c = x[rng.choice(len(x), n, replace=False)].copy()
    at = np.zeros(len(x), dtype=int)
    for _ in range(rounds):
        at = Lists(c, 1, []).order(x)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.bincount(at, minlength=n)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    order = Lists(c, 1, []).order(x)
    at = order[:, 0]
    asked = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    s = x[asked] @ x.T
    near = np.argpartition(-s, min(k, len(x) - 1), axis=1)[:, :k]
    place = np.argsort(order[asked], axis=1)  # of each list in the question's order
    needed = np.take_along_axis(place, at[near], axis=1)
    share = np.bincount(at, minlength=n) / len(x)
    return Lists(c, int(np.quantile(needed, REACHED, method="higher")) + 1, [max(1, ceil(p * rows / PER_SLOT)) for p in share])


def by_lists(corpus: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): nearly the k nearest by cosine, from the lists of the centroids nearest to a question, with exact scores.

    Every vector is in the list of its nearest centroid; lists are dealt into slots, so that none meets in one task. A question gets
    fewer than k only where its lists hold fewer. Vectors of another dimension than the sample's first one are a list of their own.
    """
    live = lambda df, c: df.where(usable(F.col(c)) & F.exists(c, lambda e: e != 0))
    own = live(corpus.select("id", F.col("embedding").cast("array<double>").alias("v")), "v")
    asked = live(questions.select("qid", F.col("query_vector").cast("array<double>").alias("v")), "v")
    rows, parts = own.count(), 1 << 30
    first = F.pmod(F.xxhash64("id", "v"), F.lit(parts))
    some = own.where(first < int(parts * min(1.0, 1.25 * SAMPLE / max(rows, 1) + 100 / max(rows, 1)))).orderBy(first, "id").limit(SAMPLE)
    vs = [np.array(r.v) for r in some.select("v").toLocalIterator()]
    if not vs:
        return nearest(corpus, questions, k)
    d = len(vs[0])
    lists = fit_lists(np.stack([v for v in vs if len(v) == d]), rows, k)
    shared = corpus.sparkSession.sparkContext.broadcast(lists)

    def run(most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(1)
                size = v.value_lengths().to_numpy()
                fit = np.flatnonzero(size == d)
                found = [[-int(s)] for s in size]
                if len(fit):
                    order = shared.value.order(_unit(v.take(pa.array(fit)).flatten().to_numpy().reshape(-1, d)))[:, : most or shared.value.probes]
                    for r, o in zip(fit.tolist(), order.tolist(), strict=True):
                        found[r] = o
                yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(found, pa.list_(pa.int64()))], names=["id", "v", "lists"])

        return place

    def placed(df: DataFrame, key: str, most: int | None) -> DataFrame:
        kind = df.schema[key].dataType.simpleString()
        rows = df.select(key, "v").mapInArrow(run(most), f"id {kind}, v array<double>, lists array<bigint>")
        rows = rows.select("id", "v", F.explode("lists").alias("list"))
        return rows.withColumn("slots", F.when(F.col("list") < 0, 1).otherwise(F.element_at(F.lit(lists.slots), (F.greatest("list", F.lit(0)) + 1).cast("int"))))

    def dealt(df: DataFrame, salt: Column) -> DataFrame:
        slots = df.withColumn("slot", F.col("list") * F.lit(1 << 24) + salt)
        return slots.repartition("slot").sortWithinPartitions("slot")

    there = dealt(placed(own, "id", 1), F.pmod(F.xxhash64("id", "v"), F.col("slots")))
    salts = placed(asked, "qid", None).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    here = dealt(salts, F.col("salt")).withColumnsRenamed({"id": "qid", "v": "query_vector"})
    return search(packed(there, "id", "v", "slot").join(asking(here, "slot"), F.col("part") == F.col("q_part")), k)
