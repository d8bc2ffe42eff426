"""Exact Jaccard self-join on word shingles by rare-first prefix filtering.

Documents with equal shingle sets form a class; only classes are joined. A counter table of fixed size over all classes'
shingles orders shingles rare-first. Two sets of similarity t share a shingle within the first ``n - ceil(t n) + 1`` of their
order, so classes meet on these prefixes, and only prefixes shared by two classes stay. Length and positional filters apply
to each meeting. The suffix filter then bounds the intersection of a pair from how many shingles each set has between fixed
pivots, before any text is fetched; what is left is verified exactly, each pair once.

Links are needed for connectivity, so :func:`components` does not expand a bucket of m classes to m^2 pairs: first every class is
verified against a few pivots of its bucket (linear in m), and then, exactly, all pairs that meet, are not yet connected and
were not verified before. No link between components is lost, and a group of near copies costs a star. It gives components only;
:func:`links` gives every link between classes, and their members.

Texts with the same 64-bit hash of their set and the same number of shingles count as one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.lineage import discard, stored
from .batches import bounded, map_batches
from .shingles import set_id, shingles

WORDS, NUM, DEN = 5, 80, 100
#: Counters of the rarity table: fixed, 4 MB for any corpus. Collisions only blur the order; results are exact for any order.
COUNTERS, SLICE = 1 << 20, 1 << 10
#: A shingle counted more often than this is dealt to several tasks.
HOT = 2_000
#: Orders by which buckets choose their pivot among their most central classes.
PIVOTS = 4
#: Classes whose prefixes a task remembers having sent.
SENT = 200_000
#: Parts between the pivots of the suffix filter; sets of which a part has more than 65,535 shingles are not filtered.
PARTS = 64


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def part_sizes(s: np.ndarray) -> bytes:
    """How many of the sorted hashes lie in each of PARTS equal parts of their range; empty if that takes more than 16 bits."""
    sizes = np.bincount((s >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS)
    return sizes.astype("<u2").tobytes() if sizes.max() < 1 << 16 else b""


def suffix_bounds(x: list[bytes], y: list[bytes], most: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of pairs of sets: parts share no more than the smaller has; ``most`` where unknown."""
    out = most.copy()
    known = np.array([bool(a and b) for a, b in zip(x, y, strict=True)], dtype=bool)
    if known.any():
        a, b = (np.frombuffer(b"".join(v for v, k in zip(z, known, strict=True) if k), dtype="<u2").reshape(-1, PARTS) for z in (x, y))
        out[known] = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    return out


def _signatures(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Per row (id, cls, n, parts); per task also slices of its shingle counts (slice, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(COUNTERS, dtype=np.uint32), set()
        kind = None
        names = ["id", "cls", "n", "parts", "slice", "counts"]
        for batch in batches:
            kind = batch.column(0).type
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            ids = [set_id(s) if len(s) else None for s in sets]
            for c, s in zip(ids, sets, strict=True):
                if c is not None and c not in seen:
                    if len(seen) < SENT:
                        seen.add(c)
                    np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([part_sizes(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        at = np.flatnonzero(counts.reshape(-1, SLICE).any(axis=1)).tolist()
        if at:
            m = len(at)
            blobs = [counts[k * SLICE : (k + 1) * SLICE].tobytes() for k in at]
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=names)

    bounded(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, cls long, n int, parts binary, slice int, counts binary")


def _rarity(slices: DataFrame) -> np.ndarray:
    """The tasks' counters summed: SLICE counters per row, streamed through the tasks that own the slices."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(blob, dtype=np.uint32)
                sums[k] = sums[k] + c if k in sums else c.astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(c, 2**32 - 1).astype(np.uint32).tobytes() for c in sums.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros(COUNTERS, dtype=np.uint32)
    for r in slices.repartition("slice").mapInArrow(add, "slice int, counts binary").toLocalIterator():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], dtype=np.uint32)
    return out


def _prefixes(docs: DataFrame, text: str, words: int, num: int, den: int, rarity) -> DataFrame:
    """(h, salt, cls, np, mid): the rare-first prefix of each class, once per task that meets the class.

    np packs the set's size and the place in the prefix. mid is how often the prefix's shingles are counted (log2, in eighths):
    of near copies the one with the fewest changes of its own has the largest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counts = rarity.value
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for t in batch.column(0).to_pylist():
                s = shingles(t, words)
                if not len(s) or (c := set_id(s)) in seen:
                    continue
                if len(seen) < SENT:
                    seen.add(c)
                often = counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort((s, often))[: prefix_length(len(s), num, den)]
                h, n = s[order], len(order)
                parts = often[order] // HOT + 1
                mid = int(8 * np.log2(1.0 + often[order]).mean())
                salt = np.where(parts > 1, 1 + c % parts.astype(np.int64), 0)  # 0: not frequent
                for col, v in zip(cols, (h.view(np.int64), salt, np.full(n, c), (len(s) << 32) + np.arange(n), np.full(n, mid)), strict=True):
                    col.append(v)
            if cols[0]:
                v = [np.concatenate(c) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(v[0]), pa.array(v[1].astype(np.int32)), pa.array(v[2]), pa.array(v[3]), pa.array(v[4].astype(np.int32))], names=["h", "salt", "cls", "np", "mid"])

    bounded(docs.sparkSession)
    return docs.select(text).mapInArrow(run, "h long, salt int, cls long, np long, mid int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """(h, cls, n, pos, mid) of the prefix rows whose shingle at least two classes have, each once.

    Rows stream in order; nothing is gathered. A frequent shingle is dealt to several tasks and its rows all stay.
    """

    def settle(table: pa.Table, held: list) -> pa.Table:
        """What can be decided of rows in order; the last one is held back, as the next may be its partner or its copy."""
        h, salt, cls, packed = (table.column(k).to_numpy() for k in ("h", "salt", "cls", "np"))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1]) | (packed[1:] != packed[:-1])
        at = np.flatnonzero(new)
        same = h[at][1:] == h[at][:-1]
        paired = (salt[at] > 0) | np.append(False, same) | np.append(same, False)
        paired[0] |= held[1] and held[0] is not None
        held[0], held[1] = table.slice(int(at[-1]), 1), bool(paired[-1])
        return table.take(pa.array(at[:-1][paired[:-1]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None, False]
        waiting, rows = [], 0

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                packed = table.column("np").to_numpy()
                n, pos = (packed >> 32).astype(np.int32), (packed & 0xFFFFFFFF).astype(np.int32)
                columns = [table.column("h"), table.column("cls"), pa.array(n), pa.array(pos), table.column("mid")]
                yield from pa.Table.from_arrays(columns, names=["h", "cls", "n", "pos", "mid"]).combine_chunks().to_batches()

        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= 100_000:
                table = pa.Table.from_batches(waiting)
                yield from out(settle(pa.concat_tables([held[0], table]) if held[0] is not None else table, held))
                waiting, rows = [], 0
        if waiting:
            table = pa.Table.from_batches(waiting)
            yield from out(settle(pa.concat_tables([held[0], table]) if held[0] is not None else table, held))
        if held[1]:
            yield from out(held[0])

    rows = prefixes.repartition("h", "salt").sortWithinPartitions("h", "cls", "np")
    return rows.mapInArrow(run, "h long, cls long, n int, pos int, mid int")


def _could_link(na: Column, nb: Column, pa_: Column, pb: Column, num: int, den: int) -> Column:
    """Length filter, and positional filter at this common shingle (which holds at the first one of every linked pair)."""
    length = F.least(na, nb) * F.lit(den) >= F.greatest(na, nb) * F.lit(num)
    most = F.least(na - pa_, nb - pb)
    return length & (most * F.lit(num + den) >= (na + nb) * F.lit(num))


def linked(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    """den * |a & b| >= num * |a | b| for sorted sets; false where either is empty."""
    if not len(a) or not len(b):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


def _suffix_filtered(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, an, b, bn) whose sets can share enough, by the sizes of their parts."""
    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("parts").alias("ap"))
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("parts").alias("bp"))
    both = pairs.join(one, ["a", "an"]).join(two, ["b", "bn"]).select("a", "an", "b", "bn", "ap", "bp")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        an, bn = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 3))
        bound = suffix_bounds(batch.column(4).to_pylist(), batch.column(5).to_pylist(), np.minimum(an, bn))
        return batch.select([0, 1, 2, 3]).filter(pa.array((num + den) * bound >= num * (an + bn)))

    return map_batches(both, run, "a long, an int, b long, bn int")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, an, b, bn) of classes that link, as (a, b) node names."""
    one = texts.select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("text").alias("at"))
    two = texts.select(F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("text").alias("bt"))
    both = pairs.join(one, ["a", "an"]).join(two, ["b", "bn"]).select("a", "an", "b", "bn", "at", "bt")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept: dict[int, np.ndarray] = {}

        def of(cls: int, t: str) -> np.ndarray:
            if cls not in kept:
                kept[cls] = shingles(t, words)
            return kept[cls]

        c = [batch.column(k).to_pylist() for k in (0, 2, 4, 5)]
        ok = [linked(of(a, s), of(b, t), num, den) for a, b, s, t in zip(*c, strict=True)]
        return pa.RecordBatch.from_arrays(list(batch.columns[:4]), names=["a", "an", "b", "bn"]).filter(pa.array(ok))

    return map_batches(both, run, "a long, an int, b long, bn int")


def _node(cls: str, n: str) -> Column:
    return F.struct(F.col(cls).alias("c"), F.col(n).alias("n"))


def _pairs(meetings: DataFrame) -> DataFrame:
    """(a, an, b, bn) of meetings, each pair once, the lesser class first."""
    one, two = _node("a", "an"), _node("b", "bn")
    ordered = meetings.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
    return ordered.select(F.col("x.c").alias("a"), F.col("x.n").alias("an"), F.col("y.c").alias("b"), F.col("y.n").alias("bn"))


@dataclass(frozen=True)
class _Join:
    """What both forms of the join need: rows (id, cls, n), classes (cls, n, id, parts), meetings, and texts of classes that meet."""

    rows: DataFrame
    named: DataFrame
    met: DataFrame
    texts: DataFrame
    words: int
    num: int
    den: int

    def verified(self, pairs: DataFrame) -> DataFrame:
        return _verified(_suffix_filtered(pairs, self.named, self.num, self.den), self.texts, self.words, self.num, self.den)


def _prepared(docs: DataFrame, key: str, text: str, words: int, num: int, den: int) -> _Join:
    spark = docs.sparkSession
    # rows go by their id and the hash of their text: of many texts under one id each is met by its own class only
    src = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("h")).alias("id"), F.col(text).alias("text"))
    signed = stored(_signatures(src, "id", "text", words), "signatures")
    rows = signed.where("slice is null").select("id", "cls", "n", "parts")
    table = _rarity(signed.where("slice is not null").select("slice", "counts"))
    rarity = spark.sparkContext.broadcast(table)
    met = stored(_shared(_prefixes(src, "text", words, num, den, rarity)), "prefixes")

    # one text per class that meets another; classes are named by (cls, n)
    named = rows.where("n > 0").groupBy("cls", "n").agg(F.min("id").alias("id"), F.min("parts").alias("parts"))
    wanted = stored(named.join(met.select("cls", "n").distinct(), ["cls", "n"], "left_semi"), "wanted")
    asked = wanted.select("cls", "n", F.col("id.key").alias("wkey"), F.col("id.h").alias("wh"))
    same = F.col("id.key").eqNullSafe(F.col("wkey")) & (F.col("id.h") == F.col("wh"))
    texts = stored(src.join(asked, same).select("cls", "n", "text").dropDuplicates(["cls", "n"]), "texts")
    return _Join(rows.select(F.col("id.key").alias("id"), "cls", "n"), wanted, met, texts, words, num, den)


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (smallest key reachable by links, itself included).

    Null and empty texts, and texts without a word, have no shingles and link with nothing. Texts under ``words`` words have
    one shingle. Rows with equal sets are linked. Repeated rows are rows of their own with the same component. Null keys never
    become a component's id unless nothing else is there. Whole texts count; other columns are not read.
    """
    j = _prepared(docs, key, text, words, num, den)
    rows, met = j.rows, j.met
    turn = F.pmod(F.col("h"), F.lit(PIVOTS))
    member = F.struct((-F.col("mid")).alias("m"), F.xxhash64("cls", "n", turn).alias("o"), F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"))
    pivots = met.groupBy("h").agg(F.min(member).alias("p")).select("h", "p.b", "p.bn", "p.bp")
    star = (
        met.join(pivots, "h")
        .where(((F.col("cls") != F.col("b")) | (F.col("n") != F.col("bn"))) & _could_link(F.col("n"), F.col("bn"), F.col("pos"), F.col("bp"), num, den))
        .select(F.col("cls").alias("a"), F.col("n").alias("an"), "b", "bn")
    )
    star = stored(_pairs(star), "star")
    first = stored(j.verified(star), "links")
    comp = connected_components(first.select(_node("a", "an").alias("src"), _node("b", "bn").alias("dst")))

    at = met.join(comp.select(F.col("id.c").alias("cls"), F.col("id.n").alias("n"), "component"), ["cls", "n"], "left")
    at = stored(at.withColumn("component", F.coalesce("component", _node("cls", "n"))), "met")
    per = at.groupBy("h", "component").agg(F.count("*").alias("m"))
    mixed = per.groupBy("h").agg(F.max_by("component", "m").alias("top"), F.count("*").alias("k")).where("k > 1").select("h", "top")
    inside = at.join(mixed, "h").select("h", "cls", "n", "pos", "component", (F.col("component") != F.col("top")).alias("minor"))
    x = inside.where("minor").select("h", F.col("cls").alias("a"), F.col("n").alias("an"), F.col("pos").alias("ap"), F.col("component").alias("ac"))
    y = inside.select("h", F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"), F.col("component").alias("bc"), F.col("minor").alias("bm"))
    across = (
        x.join(y, "h")
        .where((F.col("ac") != F.col("bc")) & (~F.col("bm") | (F.struct("a", "an") < F.struct("b", "bn"))))
        .where(_could_link(F.col("an"), F.col("bn"), F.col("ap"), F.col("bp"), num, den))
        .select("a", "an", "b", "bn")
    )
    across = _pairs(across).join(star, ["a", "an", "b", "bn"], "left_anti")
    second = stored(j.verified(across), "links")
    links = first.unionByName(second)
    comp = connected_components(links.select(_node("a", "an").alias("src"), _node("b", "bn").alias("dst")))

    named = rows.where("n > 0").groupBy("cls", "n").agg(F.min("id").alias("id"))
    classes = named.join(comp.select(F.col("id.c").alias("cls"), F.col("id.n").alias("n"), "component"), ["cls", "n"], "left")
    classes = classes.withColumn("component", F.coalesce("component", _node("cls", "n")))
    least = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    named_components = stored(classes.join(least, "component").select("cls", "n", "component_id"), "classes")
    discard(met, j.texts, j.named, star, at, first, second)
    found = rows.join(named_components, ["cls", "n"], "left")
    return found.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", F.col("id")).alias("component_id"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """((a, b) for every two linked classes, named by the smallest key of their rows, a < b; (key, class) for every row).

    Rows of a class have equal sets and are linked with each other and with all rows of a linked class. Rows without a
    shingle have a null class. Every pair that meets is verified once, so work grows with the number of near pairs; where only
    groups are needed, :func:`components` is cheaper.
    """
    j = _prepared(docs, key, text, words, num, den)
    x = j.met.select("h", F.col("cls").alias("a"), F.col("n").alias("an"), F.col("pos").alias("ap"))
    y = j.met.select("h", F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"))
    meet = x.join(y, "h").where((F.struct("a", "an") < F.struct("b", "bn")) & _could_link(F.col("an"), F.col("bn"), F.col("ap"), F.col("bp"), num, den))
    found = j.verified(_pairs(meet))
    named = stored(j.rows.where("n > 0").groupBy("cls", "n").agg(F.min("id").alias("id")), "classes")
    one = named.select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("id").alias("x"))
    two = named.select(F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("id").alias("y"))
    pairs = stored(found.join(one, ["a", "an"]).join(two, ["b", "bn"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "pairs")
    discard(j.met, j.texts, j.named)
    members = j.rows.join(named.withColumnRenamed("id", "class"), ["cls", "n"], "left")
    return pairs, members.select(F.col("id").alias(key), "class")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of each group that links, at any distance: a row of the group's smallest key, all columns.

    Rows are judged one by one, not by their key: of rows with the same key and text one stays, and of texts that share a
    key without being linked each stays. Of several texts of the smallest key the one with the smallest hash stays; null keys
    come last. Rows without a shingle are linked with nothing and all stay.
    """
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("h"))
    tagged = docs.select(row.alias("__row"), F.col(text).alias("__text"))
    found = components(tagged, "__row", "__text").where("n_shingles > 0")
    verdict = found.groupBy("__row").agg(F.any_value("component_id").alias("least"), F.count("*").alias("copies"))
    verdict = stored(
        verdict.select("__row.*", F.when(F.col("least") != F.col("__row"), "gone").when(F.col("copies") > 1, "copied").alias("verdict")).where("verdict is not null"), "verdicts"
    ).select(F.col("key").alias("__key"), F.col("h").alias("__h"), "verdict")
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(text)) == F.col("__h"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(verdict.drop("verdict"), same, "left_anti")
    copied = docs.join(verdict.where("verdict = 'copied'"), same).dropDuplicates(["__key", "__h"])
    return kept.select(*own).unionByName(copied.select(*own))
