"""Exact removal of repeated byte strings with an enhanced suffix array in buckets.

Two equal strings of ``length`` bytes hold the same anchor at the same place: the smallest hash of 8 bytes within their first
WINDOW positions. Every start position belongs to one anchor, and starts of equal strings to anchors with an equal key (the
bytes after the anchor that all of these strings share). Anchors whose key is unique cannot repeat and leave first. Where an
anchor's whole context (all strings that start at its positions) occurs again, all of it repeats. The rest, one context per
distinct content, is brought together by key: the suffixes at the anchors' positions are sorted (a sparse suffix array),
common prefixes of neighbours are taken, and a stack scan walks the tree of common-prefix intervals of ``length`` bytes or
more. An interval whose suffixes are preceded by different bytes is a maximal repeat, put out with all its occurrences; others are
inside a repeat that starts one byte before.

Suffixes of keys that more than MOST contexts share do not meet in one task: they are bucketed, position by position, by a 128-bit
fingerprint of their first ``length`` bytes, which takes any group size; such repeats are put out at that length. Where only what is
covered is asked, WIDTH positions are looked at together first: all their strings hold the same bytes, which are their key. A part whose
key is unique cannot repeat, parts that are equal repeat as a whole, and only the parts of a key with several contents go on to single
positions. Equal texts are one class and are compared once.

What counts as equal without a look at the bytes: texts by 64-bit hash and size, contexts of one key by 64-bit hash, and
the strings and parts of frequent keys by their fingerprint. Strings of other keys are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import discard, stored
from .batches import bounded, map_batches

LENGTH = 400
#: Contexts of one key that a task sorts at most (some MB of suffixes).
MOST = 256
#: Start positions of a frequent key that are looked at together before single ones.
WIDTH = 25
#: Start positions that are looked at together in a text; bounds memory for very long texts.
SLAB = 400_000
#: Bytes of contexts that are sorted together.
TOGETHER = 400_000
_LOW = np.uint64((1 << 20) - 1)


def _window(length: int) -> int:
    return length // 2


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start): each start of a string of ``length`` bytes belongs to the range of one anchor."""
    n, w = len(text), _window(length)
    if n < length:
        return (np.empty(0, dtype=np.int64),) * 3
    b = np.frombuffer(text, dtype=np.uint8)
    out = []
    for p0 in range(0, n - length + 1, SLAB):
        starts = min(SLAB, n - length + 1 - p0)
        size = starts + w - 1
        h = np.zeros(size, dtype=np.uint64)
        for k in range(8):
            h <<= np.uint64(8)
            h |= b[p0 + k : p0 + k + size]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h = (h & ~_LOW) | np.arange(size, dtype=np.uint64)  # the first of equal hashes
        pad = -size % w
        rows = np.append(h, np.full(pad, np.iinfo(np.uint64).max)).reshape(-1, w)
        head = np.minimum.accumulate(rows, axis=1).ravel()
        tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(tail[:starts], head[w - 1 : w - 1 + starts]) & _LOW).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        lo = np.append(0, cut)
        out.append((at[lo] + p0, lo + p0, np.append(cut, starts) - 1 + p0))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _hash(x: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(x)
    return h - (1 << 64) if h >> 63 else h


def _common(a: bytes, b: bytes, length: int) -> int:
    """Bytes that two strings share at their start; 0 if fewer than ``length``."""
    if a[:length] != b[:length]:
        return 0
    low, high = length, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[length:mid] == b[length:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _suffixes(contexts: list[bytes], starts: list[int]) -> list[tuple[bytes, int, int]]:
    return sorted((c[o:], i, o) for i, c in enumerate(contexts) for o in range(starts[i]))


def covered_runs(contexts: list[bytes], starts: list[int], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(context, offset, bytes): what repeats of ``length`` bytes or more at the first ``starts[i]`` offsets of context i cover, as maximal runs.

    A suffix shares most with one of its neighbours in order, so its longest repeat is known without the groups: the runs of a
    context are at most as many as its starts, however the groups lie within each other.
    """
    suffixes = _suffixes(contexts, starts)
    shared = [0, *(_common(a[0], b[0], length) for a, b in zip(suffixes, suffixes[1:])), 0]
    ends = sorted((i, o, o + most) for k, (_, i, o) in enumerate(suffixes) if (most := max(shared[k], shared[k + 1])))
    out: list[list[int]] = []
    for i, s, e in ends:
        if out and out[-1][0] == i and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([i, s, e])
    return [(i, s, e - s) for i, s, e in out]


def maximal_repeats(contexts: list[bytes], starts: list[int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bytes, [(context, offset)]) of the repeats of ``length`` bytes or more at the first ``starts[i]`` offsets of context i.

    A repeat's left end is diverse where its occurrences are preceded by different bytes; the start of a context counts as
    different from all, since what is before it belongs to another anchor.
    """
    suffixes = _suffixes(contexts, starts)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    stack: list[tuple[int, int]] = []  # (common prefix, first suffix) of the open intervals

    def close(common: int, first: int, last: int) -> None:
        group = suffixes[first : last + 1]
        before = {contexts[i][o - 1] if o else -1 for _, i, o in group}
        if -1 in before or len(before) > 1:
            out.append((common, [(i, o) for _, i, o in group]))

    for k in range(1, len(suffixes) + 1):
        common = _common(suffixes[k - 1][0], suffixes[k][0], length) if k < len(suffixes) else 0
        first = k - 1
        while stack and stack[-1][0] > common:
            size, first = stack.pop()
            close(size, first, k - 1)
        if common and (not stack or stack[-1][0] < common):
            stack.append((common, first))
    return out


def _anchor_rows(classed: DataFrame, length: int) -> DataFrame:
    """(key, hc, cls, n, a, lo, hi) of every anchor; a task sends the anchors of equal texts once while it remembers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen = _window(length), set()
        for batch in batches:
            keys, contents, rows = [], [], []
            for t, c, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n < length or (c, n) in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add((c, n))
                text = t.encode("utf-8", "surrogatepass")
                a, lo, hi = anchors(text, length)
                share = length - w + 1
                for x, y, z in zip(a.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    keys.append(_hash(text[x : x + share]))
                    contents.append(_hash(text[y : z + length]) ^ (x - y))
                rows.append(np.stack([np.full(len(a), c), np.full(len(a), n), a, lo, hi]))
            if rows:
                v = np.concatenate(rows, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contents, pa.int64()), *[pa.array(x) for x in v]], names=["key", "hc", "cls", "n", "a", "lo", "hi"])

    bounded(classed.sparkSession)
    return classed.select("text", "cls", "n").mapInArrow(run, "key long, hc long, cls long, n long, a long, lo long, hi long")


def _contexts(chosen: DataFrame, length: int) -> DataFrame:
    """(key, hc, cls, n, lo, starts, content, hot, anchor) from rows of texts with the list of their chosen anchors."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(9)]
        for c, n, t, ws in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = t.encode("utf-8", "surrogatepass")
            for x in ws:
                for col, v in zip(cols, (x["key"], x["hc"], c, n, x["lo"], x["hi"] - x["lo"] + 1, text[x["lo"] : x["hi"] + length], x["hot"], x["anchor"]), strict=True):
                    col.append(v)
        kinds = [*[pa.int64()] * 6, pa.binary(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "hc", "cls", "n", "lo", "starts", "content", "hot", "anchor"])

    return map_batches(chosen.select("cls", "n", "text", "ws"), run, "key long, hc long, cls long, n long, lo long, starts long, content binary, hot boolean, anchor long")


_REPEATS = "repeat binary, bytes long, key long, hc long, cls long, n long, start long, at long"


def _repeat_rows(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary(), *[pa.int64()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _REPEATS.split(", ")])


def _sorted_repeats(contexts: DataFrame, length: int, grouped: bool) -> DataFrame:
    """_REPEATS, of the context (key, hc) at offset ``at``, from contexts brought together by key: maximal repeats with all occurrences
    if ``grouped``, else only the runs of bytes that they cover (``repeat`` is null), which do not multiply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(8)]
            if not grouped:
                for i, o, covered in covered_runs([r[6] for r in rows], [r[5] for r in rows], length):
                    key, hc, cls, n, lo = rows[i][:5]
                    for col, v in zip(cols, (None, covered, key, hc, cls, n, lo + o, o), strict=True):
                        col.append(v)
                return _repeat_rows(cols)
            for common, found in maximal_repeats([r[6] for r in rows], [r[5] for r in rows], length):
                name = xxhash.xxh3_128_digest(rows[found[0][0]][6][found[0][1] : found[0][1] + common])
                for i, o in found:
                    key, hc, cls, n, lo = rows[i][:5]
                    for col, v in zip(cols, (name, common, key, hc, cls, n, lo + o, o), strict=True):
                        col.append(v)
            return _repeat_rows(cols)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if size >= TOGETHER and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield flush(held)

    own = contexts.where(~F.col("hot")).select("key", "hc", "cls", "n", "lo", "starts", "content")
    return own.repartition("key").sortWithinPartitions("key").mapInArrow(run, _REPEATS)


def _counted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """The same for frequent keys: one row per start, bucketed by the fingerprint of its string."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for key, hc, c, n, lo, starts, content in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            for o in range(starts):
                for col, v in zip(cols, (xxhash.xxh3_128_digest(content[o : o + length]), key, hc, c, n, lo + o, o), strict=True):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["repeat", "key", "hc", "cls", "n", "start", "at"])

    each = map_batches(contexts.where("hot").select("key", "hc", "cls", "n", "lo", "starts", "content"), run, _REPEATS.replace(" bytes long,", ""))
    place = F.struct("cls", "n", "start")
    again = each.groupBy("repeat").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x != y").select("repeat")
    return each.join(again, "repeat", "left_semi").withColumn("bytes", F.lit(length).cast("long"))


_PARTS = "sub long, part binary, key long, hc long, cls long, n long, start long, at long, starts long"


def parts(content: bytes, starts: int, anchor: int, length: int, width: int) -> list[tuple[int, bytes, int, int]]:
    """(key, fingerprint, first offset, offsets) of the runs of ``width`` starts, counted back from the anchor at ``anchor``; equal
    strings of two contexts are in runs of an equal key, and equal runs hold the same strings."""
    out = []
    for g in range((anchor - starts + 1) // width, anchor // width + 1):
        last, least = anchor - g * width, anchor - g * width - width + 1  # the run, were it not cut off by the context's ends
        first, end = max(0, least), min(starts - 1, last)
        out.append((_hash(content[last : least + length]) ^ g, xxhash.xxh3_128_digest(content[first : end + length], seed=anchor - first), first, end - first + 1))
    return out


def _covered_parts(contexts: DataFrame, length: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """_REPEATS of frequent keys as runs of covered bytes (``repeat`` is null), and the tables behind it."""
    width = min(WIDTH, _window(length) // 2)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(9)]
        for key, hc, c, n, lo, starts, content, anchor in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            for sub, part, at, size in parts(content, starts, anchor, length, width):
                for col, v in zip(cols, (sub, part, key, hc, c, n, lo + at, at, size), strict=True):
                    col.append(v)
        kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _PARTS.split(", ")])

    def single(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for key, hc, c, n, lo, content, ws in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            for w in ws:
                for o in range(w["at"], w["at"] + w["starts"]):
                    for col, v in zip(cols, (xxhash.xxh3_128_digest(content[o : o + length]), key, hc, c, n, lo + o, o), strict=True):
                        col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["repeat", "key", "hc", "cls", "n", "start", "at"])

    hot = contexts.where("hot").select("key", "hc", "cls", "n", "lo", "starts", "content", "anchor")
    each = stored(map_batches(hot, run, _PARTS), "parts")
    place = F.struct("cls", "n", "start")
    per = each.groupBy("sub", "part").agg(F.min(F.struct("key", "hc", "at", "starts")).alias("one"), F.min(place).alias("x"), F.max(place).alias("y"))
    per = stored(per.select("sub", "part", "one", (F.col("x") != F.col("y")).alias("whole")), "per-part")
    several = stored(per.groupBy("sub").agg(F.count("*").alias("k")).where("k > 1").select("sub"), "several")
    whole = each.join(per.where("whole").select("sub", "part"), ["sub", "part"], "left_semi")
    whole = whole.select(F.lit(None).cast("binary").alias("repeat"), (F.col("starts") - 1 + length).alias("bytes"), "key", "hc", "cls", "n", "start", "at")
    left = per.join(several, "sub", "left_semi").select("one.*").groupBy("key", "hc").agg(F.collect_list(F.struct("at", "starts")).alias("ws"))
    alone = stored(map_batches(hot.join(left, ["key", "hc"]).select("key", "hc", "cls", "n", "lo", "content", "ws"), single, _REPEATS.replace(" bytes long,", "")), "alone")
    again = alone.groupBy("repeat").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x != y").select("repeat")
    found = alone.join(again, "repeat", "left_semi").withColumn("bytes", F.lit(length).cast("long"))
    return whole.unionByName(found), (each, per, several, alone)


def classed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with cls and n: equal texts have equal ones (hash of the text and its UTF-8 bytes; null counts as empty)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("cls", F.xxhash64(whole)).withColumn("n", F.octet_length(whole).cast("long"))


@dataclass(frozen=True)
class _Found:
    """shared: anchors (key, hc, cls, n, a, lo, hi) whose key recurs; whole: (key, hc) of contexts that recur as a whole; texts
    (cls, n, text) with such anchors; repeats: _REPEATS between one context of each content, by group or as runs."""

    shared: DataFrame
    whole: DataFrame
    texts: DataFrame
    repeats: DataFrame
    done: tuple[DataFrame, ...]


def _found(docs: DataFrame, text: str, length: int, grouped: bool) -> _Found:
    if length < 16:
        raise ValueError("length must be 16 at least")
    src = classed(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")))
    found = stored(_anchor_rows(src, length), "anchors")
    place = F.struct("cls", "n", "a")
    # stored, so that the join's sides come straight from their shuffles and a frequent key can be split
    again = stored(found.groupBy("key").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x != y").select("key"), "keys")
    shared = stored(found.join(again, "key", "left_semi"), "shared")
    discard(found, again)

    per_content = shared.groupBy("key", "hc").agg(F.min(F.struct("cls", "n", "a", "lo", "hi")).alias("one"), F.min(place).alias("x"), F.max(place).alias("y"))
    per_content = stored(per_content.select("key", "hc", "one", (F.col("x") != F.col("y")).alias("whole")), "contents")
    open_keys = stored(per_content.groupBy("key").agg(F.count("*").alias("k"), F.max(~F.col("whole")).alias("part")).where("k > 1 and part"), "open")
    chosen = per_content.join(open_keys, "key").select("one.cls", "one.n", F.struct("key", "hc", "one.lo", "one.hi", (F.col("k") > MOST).alias("hot"), (F.col("one.a") - F.col("one.lo")).alias("anchor")).alias("w"))

    wanted = shared.select("cls", "n").distinct()
    texts = stored(src.where(F.col("n") >= length).join(wanted, ["cls", "n"], "left_semi").dropDuplicates(["cls", "n"]).select("cls", "n", "text"), "texts")
    contexts = stored(_contexts(texts.join(chosen.groupBy("cls", "n").agg(F.collect_list("w").alias("ws")), ["cls", "n"]), length), "contexts")
    frequent, done = (_counted_repeats(contexts, length), ()) if grouped else _covered_parts(contexts, length)
    repeats = _sorted_repeats(contexts, length, grouped).unionByName(frequent)
    return _Found(shared, per_content.where("whole").select("key", "hc"), texts, repeats, (shared, per_content, open_keys, texts, contexts, *done))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """((cls, n, spans) of the texts with repeats, (cls, n, text) of them, tables to discard once both were read).

    spans is an array of the maximal runs [start, end) of bytes that strings of ``length`` bytes cover which start anywhere else;
    texts that occur twice as a whole are not among them. ``length`` is 16 at least: an anchor takes 8 bytes.
    """
    f = _found(docs, text, length, grouped=False)
    whole = f.shared.join(f.whole, ["key", "hc"], "left_semi")
    covered = whole.select("cls", "n", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    covered = covered.unionByName(f.repeats.select("cls", "n", F.col("start").alias("s"), (F.col("start") + F.col("bytes")).alias("e")))
    covered = covered.groupBy("cls", "n", "s").agg(F.max("e").alias("e"))
    before = F.max("e").over(Window.partitionBy("cls", "n").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum("first").over(Window.partitionBy("cls", "n").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    runs = covered.withColumn("first", F.when(F.col("s") <= before, 0).otherwise(1)).withColumn("run", number)
    runs = runs.groupBy("cls", "n", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.array("s", "e"))).alias("spans")), f.texts, f.done


def repeat_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(repeat, bytes, key, start): the groups of repeated byte strings, each with all its occurrences in all rows.

    ``repeat`` names the string (128-bit fingerprint). Groups are the maximal repeats of ``length`` bytes or more within the
    contexts of an anchor, contexts that recur as a whole, and texts that rows share; strings of frequent keys have
    ``length`` bytes. A long repeat over several anchors gives a group for each of them, which overlap; every repeated byte is in one.
    """
    f = _found(docs, text, length, grouped=True)
    fingerprint = F.unhex(F.md5(F.concat_ws(":", "key", "hc")))
    every = f.shared.select("key", "hc", F.col("cls").alias("c"), F.col("n").alias("m"), "lo", "hi")
    parts = f.repeats.join(every, ["key", "hc"]).select("repeat", "bytes", F.col("c").alias("cls"), F.col("m").alias("n"), (F.col("lo") + F.col("at")).alias("start"))
    whole = every.join(f.whole, ["key", "hc"], "left_semi").select(fingerprint.alias("repeat"), (F.col("hi") - F.col("lo") + length).alias("bytes"), F.col("c").alias("cls"), F.col("m").alias("n"), F.col("lo").alias("start"))
    rows = classed(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))).where(F.col("n") >= length).select("id", "cls", "n")
    inside = parts.unionByName(whole).distinct().join(rows, ["cls", "n"]).select("repeat", "bytes", "id", "start")
    copies = rows.join(rows.groupBy("cls", "n").agg(F.count("*").alias("copies")).where("copies > 1"), ["cls", "n"], "left_semi")
    copies = copies.select(F.unhex(F.md5(F.concat_ws(":", "cls", "n"))).alias("repeat"), F.col("n").alias("bytes"), "id", F.lit(0).cast("long").alias("start"))
    out = stored(inside.unionByName(copies), "groups")
    discard(*f.done)
    return out.select("repeat", "bytes", F.col("id").alias(key), "start")


def merge(spans: list[list[int]]) -> list[list[int]]:
    """Sorted spans as maximal runs; runs that touch are one."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def without(text: bytes, runs: list[list[int]]) -> bytes:
    out, at = [], 0
    for s, e in runs:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else in the table (the same text included) is
    removed. Null counts as empty; texts under ``length`` bytes stay; a text that two rows share is removed whole if it has
    ``length`` bytes. Repeated rows are rows of their own; other columns are not read.
    """
    spans, texts, done = repeated_spans(docs, text, length)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], []]
        for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            runs = merge(s)
            kept = without(t.encode("utf-8", "surrogatepass"), runs)
            for col, v in zip(cols, (sum(e - b for b, e in runs), len(runs), hashlib.sha256(kept).hexdigest()), strict=True):
                col.append(v)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["cls", "n", "removed", "runs", "sha"])

    part = stored(map_batches(texts.join(spans, ["cls", "n"]).select("cls", "n", "text", "spans"), run, "cls long, n long, removed long, runs long, sha string"), "report")
    discard(*done)
    rows = stored(classed(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))).select("id", "cls", "n", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("own")), "rows")
    twice = rows.where(F.col("n") >= length).groupBy("cls", "n").agg(F.count("*").alias("copies")).where("copies > 1").select("cls", "n", F.lit(True).alias("twice"))
    out = rows.join(part, ["cls", "n"], "left").join(twice, ["cls", "n"], "left")
    gone = F.col("twice").isNotNull()
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_bytes"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
    )


def whole_characters(text: bytes, runs: list[list[int]]) -> list[list[int]]:
    """``runs`` shrunk to whole UTF-8 characters."""
    out = []
    for s, e in runs:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if e > s:
            out.append([s, e])
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs``, all columns, with the repeated passages taken out of ``text``, whole characters only.

    As for :func:`dedup_report`; texts of ``length`` bytes that rows share become empty. Null texts stay null.
    """
    spans, _, done = repeated_spans(docs, text, length)
    spans = stored(spans, "spans")
    discard(*done)
    own = classed(docs.select(F.col(text).alias("text")), "text").where(F.col("n") >= length).groupBy("cls", "n").agg(F.count("*").alias("copies"))
    twice = own.where("copies > 1").select("cls", "n", F.array(F.array(F.lit(0).cast("long"), F.col("n"))).alias("spans"))
    all_spans = spans.join(twice.select("cls", "n"), ["cls", "n"], "left_anti").unionByName(twice)
    all_spans = all_spans.select(F.col("cls").alias("__cls"), F.col("n").alias("__n"), F.col("spans").alias("__spans"))
    whole = F.coalesce(F.col(text), F.lit(""))
    joined = docs.join(all_spans, (F.xxhash64(whole) == F.col("__cls")) & (F.octet_length(whole) == F.col("__n")), "left")
    names, at = docs.columns, docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
            if t and s:
                raw = t.encode("utf-8", "surrogatepass")
                t = without(raw, whole_characters(raw, merge(s))).decode("utf-8", "replace")
            out.append(t)
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 : len(names)]], names=names)

    return map_batches(joined.select(*[F.col(f"`{c}`") for c in names], "__spans"), run, docs.schema)
