"""Near-duplicate vectors by product quantisation.

Vectors of one dimension have an index of their own: coarse centroids and residual codebooks are fitted on a bounded sample; every
vector is indexed in the list of its nearest centroid with one code per subspace. Each vector searches the lists whose centroids
are within a slack of its nearest one, scores their members by table lookup (its inner products with the codewords, summed by the
members' codes), and reranks those that can reach the threshold by exact cosine in double precision. A pair is found if either
of the two finds the other; slack and score bound are set on the sample, by neighbours placed right at the threshold, so that a
stated share of such pairs is found. Dimensions with under FEW vectors are compared whole.

Lists longer than BLOCK are dealt out as pairs of blocks, so no task holds a whole list. Blocks send link counts and a spanning
forest of their links, never the pairs. Equal vectors (by a 64-bit hash of their components) are one class and are compared once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.lineage import discard, stored
from .batches import bounded, bounded_sample

THRESHOLD = 0.9
#: Vectors that centroids, codebooks, slack and score bound are fitted on, at most.
SAMPLE = 20_000
#: Vectors per list aimed at; lists at most.
PER_LIST, MOST_LISTS = 256, 1024
FEW, LEAST_LISTS = 128, 8
SUBSPACES, CODEWORDS = 16, 256
#: Share of pairs at the threshold that the probes, and then the score bound, must keep.
FOUND = 0.997
BLOCK = 1024


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x d
    books: np.ndarray  # subspaces x codewords x d / subspaces
    slack: float
    bound: float

    def coarse(self, x: np.ndarray) -> np.ndarray:
        """Distances of unit vectors to the centroids."""
        sq = (x * x).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1)
        return np.sqrt(np.maximum(sq, 0))

    def split(self, x: np.ndarray) -> np.ndarray:
        s, _, w = self.books.shape
        pad = s * w - x.shape[1]
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), s, w)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """One code per subspace for the residuals to the centroids of their lists."""
        r = self.split(x - self.centroids[lists])
        out = np.empty(r.shape[:2], dtype=np.uint8)
        for k, book in enumerate(self.books):
            out[:, k] = (-2 * r[:, k] @ book.T + (book**2).sum(1)).argmin(1)
        return out

    def scores(self, q: np.ndarray, lists: np.ndarray | int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric inner products (queries x members) of one list by table lookup."""
        tables = np.einsum("qsw,scw->qsc", self.split(q), self.books)
        out = np.repeat((q @ self.centroids[lists])[:, None], len(codes), axis=1)
        for k in range(codes.shape[1]):
            out += tables[:, k, codes[:, k]]
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = (-2 * x @ c.T + (c**2).sum(1)).argmin(1)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        full = n > 0
        c[full] = sums[full] / n[full, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def fit(x: np.ndarray, rows: int, threshold: float, seed: int = 1) -> Index:
    """Centroids, codebooks, slack and bound from unit vectors ``x``; ``rows`` vectors will be indexed."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    s = min(SUBSPACES, d)
    w = -(-d // s)
    lists = int(min(MOST_LISTS, max(LEAST_LISTS, rows // PER_LIST), max(1, len(x) // 8)))
    c = _kmeans(x, lists, rng)
    index = Index(c, np.zeros((s, 1, w)), 0.0, 0.0)
    near = index.coarse(x).argmin(1)
    residual = index.split(x - c[near])
    books = np.stack([_kmeans(residual[:, k], CODEWORDS, rng, 8) for k in range(s)])
    index = Index(c, books, 0.0, 0.0)
    # neighbours right at the threshold: x turned by its angle in a random direction
    g = rng.standard_normal(x.shape)
    g -= (g * x).sum(1)[:, None] * x
    size = np.linalg.norm(g, axis=1)
    g = np.where(size[:, None] > 0, g / np.maximum(size, 1e-300)[:, None], 0)
    q = threshold * x + np.sqrt(1 - threshold**2) * g
    to_q, to_x, row = index.coarse(q), index.coarse(x), np.arange(len(x))
    needed = np.minimum(to_q[row, near] - to_q.min(1), to_x[row, to_q.argmin(1)] - to_x.min(1))  # either may find the other
    slack = float(np.quantile(needed, FOUND)) + 1e-6
    codes = index.encode(x, near)
    back = np.concatenate([books[k][codes[:, k]] for k in range(s)], axis=1)[:, :d] + c[near]
    bound = float(np.quantile((q * back).sum(1), 1 - FOUND)) - 1e-6
    return Index(c, books, slack, bound)


def whole(d: int) -> Index:
    """The index of a dimension with few vectors: one list, in which every pair is reranked."""
    return Index(np.zeros((1, d)), np.zeros((1, 1, d)), np.inf, -np.inf)


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda e: F.coalesce(e != 0, F.lit(False))), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links (rows a, columns b) connect: each node to the least id it reaches here."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    m, x, y = linked[np.ix_(rows, cols)], a[rows].copy(), b[cols].copy()
    top = np.iinfo(np.int64).max
    while True:
        x2 = np.minimum(x, np.where(m, y[None, :], top).min(1)) if len(cols) else x
        y2 = np.minimum(y, np.where(m, x2[:, None], top).min(0)) if len(rows) else y
        if (x2 == x).all() and (y2 == y).all():
            return np.concatenate([a[rows], b[cols]]), np.concatenate([x, y])
        x, y = x2, y2


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept (key = component_id).

    n_links counts the other rows linked directly, equal ones included. Only vectors of the same dimension can link; unusable
    ones (null, empty, zero, or with null or non-finite components) link with nothing. Repeated rows are rows of their own;
    other columns, labels included, are not read.
    """
    spark = vectors.sparkSession
    bounded(spark)
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    src = vectors.select(F.col(key).alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    rows = src.select("id", F.when(usable(F.col("v")), F.xxhash64(F.transform("v", lambda e: e.cast("double") + F.lit(0.0)))).alias("cls"), "v")
    each = stored(rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("v").alias("v")), "vectors")
    size = F.size("v")
    indexes = {}
    for d, n in each.groupBy(size.alias("d")).count().collect():  # a row per dimension
        if n < FEW:
            indexes[d] = whole(d)
        else:
            sample = bounded_sample(each.where(size == d), SAMPLE, "cls").select("v").toArrow()
            indexes[d] = fit(_unit(sample["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)), n, threshold)
    shared = spark.sparkContext.broadcast(indexes)
    number = np.dtype("<f4" if kind == "float" else "<f8")

    def place(batches):
        for batch in batches:
            of, vs = batch.column(2).to_numpy(), batch.column(3)
            for d in np.unique(of).tolist():
                ix, at = shared.value[d], pa.array(np.flatnonzero(of == d))
                raw = vs.take(at).flatten().to_numpy().reshape(-1, d).astype(number)
                x = _unit(raw)
                dist = ix.coarse(x)
                near = dist.argmin(1)
                probes = [np.flatnonzero(r <= r.min() + ix.slack).astype(np.int32) for r in dist]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in ix.encode(x, near)], pa.binary()), pa.array(probes, pa.list_(pa.int32())), pa.array([r.tobytes() for r in raw], pa.binary())],
                    names=["cls", "copies", "d", "list", "codes", "probes", "x"],
                )

    # the components travel as they are, so that cosines of floats are exact in half the bytes of doubles
    indexed = stored(each.select("cls", "copies", size.alias("d"), "v").mapInArrow(place, "cls long, copies long, d int, list int, codes binary, probes array<int>, x binary"), "index")
    members = indexed.groupBy("d", "list").agg(F.count("*").alias("m"))
    searches = indexed.select("d", F.explode("probes").alias("list")).groupBy("d", "list").agg(F.count("*").alias("q"))
    blocks = members.join(searches, ["d", "list"]).select("d", "list", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qb"))
    blocks = F.broadcast(blocks)  # at most MOST_LISTS rows per dimension
    own = indexed.join(blocks, ["d", "list"]).select("d", "list", F.pmod(F.xxhash64("cls"), F.col("mb")).cast("int").alias("mblock"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qblock"), "cls", "copies", "codes", "probes", "x")
    asks = indexed.toDF(*indexed.columns).withColumnRenamed("list", "home").withColumn("list", F.explode("probes")).join(blocks, ["d", "list"])
    asks = asks.select("d", "list", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("mblock"), F.pmod(F.xxhash64("cls"), F.col("qb")).cast("int").alias("qblock"), "cls", "copies", "home", "codes", "x")
    asks = asks.toDF(*asks.columns)

    def search(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"cls": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "to": pd.Series(dtype="int64")})
        if q.empty or m.empty:
            return none
        ix, at = shared.value[int(m["d"].iloc[0])], int(m["list"].iloc[0])
        a, b = q["cls"].to_numpy(), m["cls"].to_numpy()
        x, y = (_unit(np.frombuffer(b"".join(t["x"]), dtype=number).reshape(len(t), -1)) for t in (q, m))
        codes = np.frombuffer(b"".join(m["codes"]), dtype=np.uint8).reshape(len(m), -1)
        i, j = np.nonzero((ix.scores(x, at, codes) >= ix.bound) & (a[:, None] != b[None, :]))
        exact = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), 100_000):
            exact[k : k + 100_000] = np.einsum("nd,nd->n", x[i[k : k + 100_000]], y[j[k : k + 100_000]]) >= threshold
        i, j = i[exact], j[exact]
        if not len(i):
            return none
        # a pair that the member's own search finds as well is counted there for the member
        home, own_codes = q["home"].to_numpy(), np.frombuffer(b"".join(q["codes"]), dtype=np.uint8).reshape(len(q), -1)
        probes = np.zeros((len(m), len(ix.centroids)), dtype=bool)
        for k, p in enumerate(m["probes"]):
            probes[k, np.asarray(p, dtype=int)] = True
        both = probes[j, home[i]]
        books = np.arange(own_codes.shape[1])
        for h in np.unique(home[i[both]]):
            of = np.flatnonzero(both & (home[i] == h))
            for k in range(0, len(of), 50_000):
                w = of[k : k + 50_000]
                back = ix.books[books, own_codes[i[w]]].reshape(len(w), -1)[:, : y.shape[1]] + ix.centroids[h]
                both[w] = np.einsum("nd,nd->n", y[j[w]], back) >= ix.bound + 1e-9
        links = np.zeros(len(a), dtype=np.int64)
        np.add.at(links, i, m["copies"].to_numpy()[j])
        other = np.zeros(len(b), dtype=np.int64)
        np.add.at(other, j[~both], q["copies"].to_numpy()[i[~both]])
        linked = np.zeros((len(a), len(b)), dtype=bool)
        linked[i, j] = True
        node, to = _forest(linked, a, b)
        counts = pd.DataFrame({"cls": np.concatenate([a, b]), "links": np.concatenate([links, other]), "to": np.concatenate([a, b])})
        return pd.concat([counts[counts["links"] > 0], pd.DataFrame({"cls": node, "links": 0, "to": to})])

    keys = ["d", "list", "mblock", "qblock"]
    found = stored(asks.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(search, "cls long, links long, to long"), "links")
    direct = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("cls != to").select(F.col("cls").alias("src"), F.col("to").alias("dst")))
    classes = each.select("cls", "id", "copies").join(direct, "cls", "left").join(comp.withColumnRenamed("id", "cls"), "cls", "left")
    classes = classes.withColumn("component", F.coalesce("component", "cls"))
    least = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    named = stored(classes.join(least, "component").select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    discard(each, indexed, found)
    out = rows.select("id", "cls").join(named, "cls", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
