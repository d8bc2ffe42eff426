"""A stored index of layered proximity graphs for cosine search: built once, searched often, extended by appending.

Vectors are dealt to the lists of their nearest centroids, and each list into segments of SEGMENT vectors at most. A segment is one
row of the table: its vectors and a graph of them in layers, each upper layer a hashed sixteenth of the one below. A question goes
to the segments of the lists nearest to it: from the top layer, which is scanned, it descends layer by layer, each time keeping the
``ef`` best vectors seen while the neighbours of the best unvisited ones are looked at. All questions of a segment advance together,
as matrix work. New rows make segments of their own in their lists; nothing that is stored is read or written again.

Tables under a path: ``centroids`` (list, centroid, probes) and ``graphs`` (list, d, ids, x, levels, links), sorted by list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vector_search as vs

#: Links a vector chooses in the lowest layer (half as many above; as many may lead back), candidates they are chosen from, and vectors kept in a search.
LINKS, CANDIDATES, EF = 16, 64, 100
#: Vectors of a segment at most, and of a list on average when an index is built.
SEGMENT, PER_LIST = 16_384, 8_192
#: Layers of up to so many vectors are scanned.
SCANNED = 256
#: Vectors whose neighbours are looked at in one step, and questions that advance together.
WIDTH, ABREAST = 4, 256


# ---- graphs --------------------------------------------------------------------------------------------------------


def levels(keys: np.ndarray) -> np.ndarray:
    """The highest layer of each vector by a hash of its id: one in sixteen is also in the next layer."""
    out, left = np.zeros(len(keys), np.int8), keys.view(np.uint64).copy()
    going = np.ones(len(keys), bool)
    for _ in range(8):
        going &= (left & np.uint64(15)) == 0
        out[going] += 1
        left >>= np.uint64(4)
    return out


def _candidates(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other vectors of each, nearest first, and their cosines."""
    n = len(x)
    k = min(k, n - 1)
    near, score = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    step = max(1, vs.AT_ONCE // n)
    for lo in range(0, n, step):
        s = x[lo : lo + step] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(s, best, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near[lo : lo + step], score[lo : lo + step] = np.take_along_axis(best, order, axis=1), np.take_along_axis(own, order, axis=1)
    return near, score


def _apart(x: np.ndarray, near: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Which candidates become links: the nearest first, those that are nearer to an earlier link than to the vector only where
    links are left over."""
    out = np.zeros(near.shape, bool)
    for lo in range(0, len(near), 256):
        c, s = x[near[lo : lo + 256]], score[lo : lo + 256]
        among = c @ c.transpose(0, 2, 1)
        kept, count = np.zeros(s.shape, bool), np.zeros(len(s), int)
        for j in range(s.shape[1]):
            good = (count < most) & ~(kept & (among[:, j] > s[:, j : j + 1])).any(axis=1)
            kept[:, j] = good
            count += good
        rest = np.cumsum(~kept, axis=1) <= (most - count)[:, None]
        out[lo : lo + 256] = kept | (~kept & rest)
    return out


def graph(x: np.ndarray, most: int) -> np.ndarray:
    """(n, 2 * most) links of unit vectors, -1 where there are fewer: up to ``most`` of a vector's own and those that lead back."""
    n = len(x)
    if n < 2:
        return np.full((n, 2 * most), -1, np.int32)
    near, score = _candidates(x, CANDIDATES)
    chosen = _apart(x, near, score, most)
    src, dst, s = np.repeat(np.arange(n), near.shape[1])[chosen.ravel()], near[chosen], score[chosen]
    both = np.concatenate([src * n + dst, dst.astype(np.int64) * n + src])
    every, first = np.unique(both, return_index=True)
    a, b, s = every // n, every % n, np.concatenate([s, s])[first]
    order = np.lexsort((-s, a))
    a, b = a[order], b[order]
    start = np.searchsorted(a, np.arange(n))
    rank = np.arange(len(a)) - start[a]
    out = np.full((n, 2 * most), -1, np.int32)
    fits = rank < 2 * most
    out[a[fits], rank[fits]] = b[fits]
    return out


def layers(x: np.ndarray, level: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members, links between places among the members) of each layer that is not scanned, the lowest first."""
    out, k = [], 0
    while (members := np.flatnonzero(level >= k)).size > SCANNED:
        out.append((members, graph(x[members], LINKS // 2 if k else LINKS)))
        k += 1
    return out


# ---- search --------------------------------------------------------------------------------------------------------


def _descend(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, ef: int) -> np.ndarray:
    """(questions, ef) of the vectors nearest to each question that a walk along the links from its entries finds, -1 where there are fewer."""
    rows = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), len(x) + 1), bool)
    seen[:, -1] = True
    seen[rows, entries] = True

    def scores(at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, np.einsum("qd,qkd->qk", q, x[at]), -np.inf)

    held = np.full((len(q), max(ef, entries.shape[1])), -1, np.int32)
    held[:, : entries.shape[1]] = entries
    score = scores(held)
    done = held < 0
    while not done.all():
        open_ = np.where(done, -np.inf, score)
        best = np.argpartition(-open_, min(WIDTH, open_.shape[1]) - 1, axis=1)[:, :WIDTH]
        fresh = np.take_along_axis(open_, best, axis=1) > -np.inf
        np.put_along_axis(done, best, True, axis=1)
        from_ = np.where(fresh, np.take_along_axis(held, best, axis=1), -1)
        next_ = np.where((from_ >= 0)[:, :, None], links[from_], -1).reshape(len(q), -1)
        next_ = np.sort(next_, axis=1)
        again = np.zeros(next_.shape, bool)
        again[:, 1:] = next_[:, 1:] == next_[:, :-1]
        next_ = np.where(again | seen[rows, next_], -1, next_)
        seen[rows, next_] = True
        live = (next_ >= 0).any(axis=0)
        if not live.any():
            continue
        next_ = next_[:, live]
        every, value = np.concatenate([held, next_], axis=1), np.concatenate([score, scores(next_)], axis=1)
        over = np.concatenate([done, next_ < 0], axis=1)
        keep = np.argpartition(-value, ef - 1, axis=1)[:, :ef]
        held, score, done = (np.take_along_axis(z, keep, axis=1) for z in (every, value, over))
    return held


def search_segment(x: np.ndarray, graphs: list[tuple[np.ndarray, np.ndarray]], level: np.ndarray, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(question, vector) of nearly the k nearest of unit vectors for each unit question; ties of the k-th may be missing."""
    top = np.flatnonzero(level >= len(graphs))
    if not len(top):  # by chance no vector reached the layer: some of the one below
        top = graphs[-1][0][:: max(1, len(graphs[-1][0]) // SCANNED)]
    found_q, found = [], []
    for lo in range(0, len(q), ABREAST):
        own = q[lo : lo + ABREAST]
        s = own @ x[top].T
        most = min(max(k, ef), len(top))
        at = top[np.argpartition(-s, most - 1, axis=1)[:, :most]]
        for members, links in reversed(graphs):
            inner = np.searchsorted(members, at)
            inner = _descend(x[members], links, own, np.where(at >= 0, inner, -1), ef)
            at = np.where(inner >= 0, members[inner], -1)
        i, j = np.nonzero(at >= 0)
        found_q.append(i + lo)
        found.append(at[i, j])
    return np.concatenate(found_q), np.concatenate(found)


# ---- tables --------------------------------------------------------------------------------------------------------


def _live(df: DataFrame, vector: str) -> DataFrame:
    return df.where(vs.usable(F.col(vector)) & F.exists(vector, lambda e: e != 0))


def _placed(df: DataFrame, key: str, lists: vs.Lists, most: int) -> DataFrame:
    """``df`` (key, v) with ``list``: those of the ``most`` nearest centroids; vectors of another dimension have one of their own."""
    shared = df.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value.centroids.shape[1]
        for batch in batches:
            v = batch.column(1)
            size = v.value_lengths().to_numpy()
            found = [[-int(s)] for s in size]
            if len(fit := np.flatnonzero(size == d)):
                near = shared.value.order(vs._unit(v.take(pa.array(fit)).flatten().to_numpy().reshape(-1, d)))[:, :most]
                for r, o in zip(fit.tolist(), near.tolist(), strict=True):
                    found[r] = o
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(found, pa.list_(pa.int64()))], names=[key, "v", "lists"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "v").mapInArrow(run, f"`{key}` {kind}, v array<double>, lists array<bigint>").select(key, "v", F.explode("lists").alias("list"))


def _graphs(corpus: DataFrame, lists: vs.Lists) -> DataFrame:
    """One row per segment of corpus (id, embedding)."""
    own = _live(corpus.select("id", F.col("embedding").cast("array<double>").alias("v")), "v")
    placed = _placed(own, "id", lists, 1)
    sizes = placed.groupBy("list").agg(F.count("*").alias("n"))  # one row a list
    slots = F.ceil(F.col("n") * 1.25 / SEGMENT)
    dealt = placed.join(F.broadcast(sizes), "list").withColumn("slot", F.pmod(F.xxhash64("id", "v"), slots)).withColumn("h", F.xxhash64(F.lit("layer"), "id"))
    dealt = dealt.repartition("list", "slot").sortWithinPartitions("list", "slot").select("list", "slot", "id", "v", "h")
    names = ["list", "d", "ids", "x", "levels", "links"]

    def segment(at: int, ids: list[pa.Array], xs: list[np.ndarray], hs: list[np.ndarray]) -> pa.RecordBatch:
        whole, x = pa.concat_arrays(ids), np.concatenate(xs)
        level = levels(np.concatenate(hs))
        links = [part.tobytes() for _, part in layers(vs._unit(x).astype(np.float32), level)]
        one = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([x.shape[1]], pa.int32()), one, pa.array([x.tobytes()], pa.binary()), pa.array([level.tobytes()], pa.binary()), pa.array([links], pa.list_(pa.binary()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        at, rows = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists_, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((lists_[1:] != lists_[:-1]) | (slot[1:] != slot[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(slot)], strict=True):
                if rows and ((int(lists_[lo]), int(slot[lo])) != at or rows + hi - lo > SEGMENT):
                    yield segment(at[0], *held)
                    held, rows = ([], [], []), 0
                at = (int(lists_[lo]), int(slot[lo]))
                part = batch.slice(lo, hi - lo)
                held[0].append(part.column(2))
                held[1].append(part.column(3).flatten().to_numpy().reshape(hi - lo, -1))
                held[2].append(part.column(4).to_numpy())
                rows += hi - lo
        if rows:
            yield segment(at[0], *held)

    kind = corpus.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"list long, d int, ids array<{kind}>, x binary, levels binary, links array<binary>")


def build(corpus: DataFrame, path: str, k: int = 10) -> None:
    """Write the index of corpus (id, embedding) under ``path``: centroids fitted on ``SAMPLE`` vectors at most, graphs of every usable one."""
    own = _live(corpus.select("id", F.col("embedding").cast("array<double>").alias("v")), "v")
    rows, parts = own.count(), 1 << 30
    first = F.pmod(F.xxhash64("id", "v"), F.lit(parts))
    some = own.where(first < int(parts * min(1.0, 1.25 * vs.SAMPLE / max(rows, 1) + 100 / max(rows, 1)))).orderBy(first, "id").limit(vs.SAMPLE)
    sample = [np.array(r.v) for r in some.select("v").toLocalIterator()]
    d = len(sample[0]) if sample else 1
    lists = vs.fit_lists(np.stack([v for v in sample if len(v) == d]), rows, k, per_list=PER_LIST) if sample else vs.Lists(np.ones((1, 1)), 1, [1])
    centroids = [(i, c.tolist(), lists.probes) for i, c in enumerate(lists.centroids)]
    corpus.sparkSession.createDataFrame(centroids, "list long, centroid array<double>, probes int").write.parquet(f"{path}/centroids")
    _graphs(corpus, lists).write.parquet(f"{path}/graphs")


def read_lists(spark: SparkSession, path: str) -> vs.Lists:
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect())  # MOST_LISTS rows at most
    return vs.Lists(np.array([r.centroid for r in rows]), rows[0].probes, [])


def add(corpus: DataFrame, path: str) -> None:
    """Append graphs of new rows (id, embedding) to the index; ids must be new. What is stored is neither read nor written."""
    _graphs(corpus, read_lists(corpus.sparkSession, path)).write.mode("append").parquet(f"{path}/graphs")


def search(questions: DataFrame, path: str, k: int = 10, ef: int = EF) -> DataFrame:
    """(qid, id, score, rank): nearly the k nearest of the index by cosine for questions (qid, query_vector), with exact scores.

    Questions meet the segments of their lists in blocks, broadcast up to MOST_BYTES, by a shuffle beyond. Ties go to the least id.
    """
    spark = questions.sparkSession
    lists = read_lists(spark, path)
    asked = _live(questions.select("qid", F.col("query_vector").cast("array<double>").alias("v")), "v")
    here = _placed(asked, "qid", lists, lists.probes).withColumnRenamed("v", "query_vector").repartition("list").sortWithinPartitions("list")
    blocks = vs.asking(here, "list").withColumnRenamed("q_part", "list")
    n, d = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    pairs = spark.read.parquet(f"{path}/graphs").join(F.broadcast(blocks) if 8 * n * d * lists.probes <= vs.MOST_BYTES else blocks, "list").where("d = qd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qids, ids, d = batch.column(0)[r].values, batch.column(2)[r].values, batch.column(3)[r].as_py()
                q, x = (np.frombuffer(batch.column(c)[r].as_buffer()).reshape(-1, d) for c in (1, 4))
                level = np.frombuffer(batch.column(5)[r].as_buffer(), np.int8)
                graphs = []
                for layer, raw in enumerate(batch.column(6)[r]):
                    members = np.flatnonzero(level >= layer)
                    graphs.append((members, np.frombuffer(raw.as_buffer(), np.int32).reshape(len(members), -1)))
                unit, asks = vs._unit(x).astype(np.float32), vs._unit(q).astype(np.float32)
                i, j = search_segment(unit, graphs, level, asks, k, max(ef, k))
                score = vs._in_order(x[j], q[i], vs._times) / (np.sqrt(vs._in_order(x, x, vs._times))[j] * np.sqrt(vs._in_order(q, q, vs._times))[i])
                found = pa.RecordBatch.from_arrays([qids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score)], names=["qid", "id", "score"])
                yield from vs.first_ranks([found], k, "cosine").to_batches()

    of = lambda c: pairs.schema[c].dataType.elementType.simpleString()
    found = pairs.select("qids", "q", "ids", "d", "x", "levels", "links").mapInArrow(run, f"qid {of('qids')}, id {of('ids')}, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id")))).where(F.col("rank") <= k)
