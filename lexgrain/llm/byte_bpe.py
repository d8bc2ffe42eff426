"""Byte-level BPE over overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, from its own first character on, so its first
pre-tokens may be wrong; a scan depends only on where it stands, so from the first boundary that two neighbouring scans share
(there they resynchronise) the later chunk's pre-tokens are those of the whole text, and the earlier one's are taken up to there.
The pieces of a pre-token depend on nothing around it: each distinct one is encoded once while it stays in a bounded memo.
Decoding concatenates the bytes of the ids, without a look at characters.

Texts of up to SPREAD characters are chunked within the task that reads them. The chunks of longer texts are dealt to all
tasks, equal texts once, and only their ids meet again, in order, in the stitch of their text.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded, map_batches

#: Characters from one chunk's start to the next, and of the overlap in which neighbours must meet.
STEP, OVERLAP = 1 << 15, 512
#: A match that ends this near the end of a chunk might go on, or be another one, in the whole text.
MARGIN = 3
#: Characters of a text from which its chunks are dealt to several tasks.
SPREAD = 1 << 18
#: Distinct pre-tokens that are remembered, in each of two generations; longer ones than LONG characters are not.
MEMO, LONG = 100_000, 64
#: Bytes of chunks, or of ids, that are sent on together.
TOGETHER = 4 << 20


@dataclass(frozen=True)
class RankFile:
    """A file of base64 tokens and ranks, and the pattern whose matches are encoded separately."""

    path: str
    pattern: str


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def _members(kind: str, last: int) -> str:
    """The characters up to ``last`` that the tiktoken library counts to a class, as ranges for ``re``: its tables of Unicode are
    others than Python's."""
    import tiktoken

    every = "".join(chr(c) for c in range(last + 1) if not 0xD800 <= c < 0xE000)
    own = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    at = np.array([ord(c) for c in bytes(own.encode_ordinary(every)).decode()])
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    ends = np.append(starts[1:], len(at)) - 1
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[starts].tolist(), at[ends].tolist(), strict=True))


def compiled(pattern: str, last: int = 0x10FFFF) -> re.Pattern:
    r"""The pattern for ``re``, with \p{L}, \p{N} and \s written out for characters up to ``last``."""
    out, inside = [], False
    for part in re.split(r"(\\p\{\w\}|\\[sS]|\[\^?|\])", pattern):
        if part == r"\S":
            part = f"[^{_members(chr(92) + 's', last)}]"
        elif re.fullmatch(r"\\p\{\w\}|\\s", part):
            part = _members(part, last) if inside else f"[{_members(part, last)}]"
        elif part[:1] == "[" or part == "]":
            inside = part != "]"
        out.append(part)
    return re.compile("".join(out))


@dataclass(frozen=True)
class Chunk:
    """Characters ``start`` to ``end`` of a text; the next chunk starts at ``cut`` (None for the last)."""

    start: int
    end: int
    cut: int | None


class Coder:
    def __init__(self, file: RankFile, memo: int = MEMO):
        import tiktoken

        own = ranks(file.path)
        self.token = [b""] * (max(own.values()) + 1)
        for t, r in own.items():
            self.token[r] = t
        self._piece = tiktoken.Encoding("bpe", pat_str=file.pattern, mergeable_ranks=own, special_tokens={})._encode_single_piece
        self._every, self._ascii = compiled(file.pattern), compiled(file.pattern, 0x7F)
        space = _members(r"\s", 0x10FFFF)
        # white space never follows another character within a match: scans from wherever have a boundary between the two
        self._certain = re.compile(f"[^{space}](?=[{space}])")
        self._new: dict[str, array] = {}
        self._old: dict[str, array] = {}
        self._most = memo

    def scan(self, text: str) -> list[str]:
        return (self._ascii if text.isascii() else self._every).findall(text)

    def chunks(self, text: str, step: int = STEP, overlap: int = OVERLAP) -> Iterator[Chunk]:
        """Overlapping chunks. Each overlap holds a place that ends a pre-token for any scan, so neighbours always meet in it; a
        cut that has none near is put off until the next one, and a text without any stays whole."""
        start, n = 0, len(text)
        while n - start > step + overlap:
            m = self._certain.search(text, start + step)
            if m is None or n - m.end() < overlap:
                break
            cut = start + step if m.end() <= start + step + overlap - MARGIN else m.start()
            yield Chunk(start, cut + overlap, cut)
            start = cut
        yield Chunk(start, n, None)

    def ids(self, pre: str) -> array:
        found = self._new.get(pre)
        if found is not None:
            return found
        found = self._old.pop(pre, None)
        if found is None:
            found = array("i", self._piece(pre.encode()))
        if len(pre) <= LONG:
            if len(self._new) >= self._most:
                self._old, self._new = self._new, {}
            self._new[pre] = found
        return found

    def encode_chunk(self, text: str, cut: int | None, overlap: int = OVERLAP) -> tuple[array, array, int]:
        """Ids of a chunk up to where the next one takes over, (place, ids before it) of the boundaries in its first ``overlap``
        characters, and that place, counted from the next one's start. ``cut``: the next one's start, within the chunk."""
        pres = self.scan(text)
        take = len(text)
        if cut is not None:
            at = len(text)
            while pres and at > len(text) - MARGIN:
                at -= len(pres.pop())
            mine = {at}
            k = len(pres)
            while k and at > cut:
                k -= 1
                at -= len(pres[k])
                mine.add(at)
            other = cut
            for pre in ["", *self.scan(text[cut:])]:
                other += len(pre)
                if other in mine:
                    break
            else:
                raise AssertionError("neighbouring chunks do not meet")
            take = other
        out, head, at, known = array("i"), array("i"), 0, self._new.get
        for pre in pres:
            if at <= overlap:
                head.extend((at, len(out)))
            if at >= take:
                break
            out.extend(known(pre) or self.ids(pre))
            at += len(pre)
        if at <= overlap:
            head.extend((at, len(out)))
        return out, head, take - cut if cut is not None else 0

    def encode(self, text: str, step: int = STEP, overlap: int = OVERLAP) -> array:
        """Ids of a text: its chunks' ids, stitched."""
        out, sync = array("i"), 0
        for c in self.chunks(text, step, overlap):
            whole = c.start == 0 and c.cut is None
            ids, head, after = self.encode_chunk(text if whole else text[c.start : c.end], None if c.cut is None else c.cut - c.start, overlap)
            out.extend(ids[ids_before(head, sync) :] if sync else ids)
            sync = after
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def ids_before(head: array, place: int) -> int:
    """How many ids of a chunk lie before a boundary in its head."""
    return head[head[::2].index(place) * 2 + 1]


_CODERS: dict[RankFile, Coder] = {}


def coder(file: RankFile) -> Coder:
    if file not in _CODERS:
        _CODERS[file] = Coder(file)
    return _CODERS[file]


def _lists(parts: list[array]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    joined = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(p, np.int32) for p in parts if len(p))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(joined))


def _spread(docs: DataFrame, file: RankFile, text: str) -> DataFrame:
    """(_text, ids): the ids of each distinct long text by its SHA-256, from chunks that are dealt to all tasks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, held = coder(file), [], 0
        names = ["_text", "no", "cut", "chunk"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=names)
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = t.as_py()
                for no, c in enumerate(own.chunks(whole)):
                    rows.append((key, no, None if c.cut is None else c.cut - c.start, whole[c.start : c.end]))
                    held += c.end - c.start
                    if held >= TOGETHER:
                        yield pack(rows)
                        rows, held = [], 0
        if rows:
            yield pack(rows)

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(file)
        done = [own.encode_chunk(t, cut) for t, cut in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists([d[0] for d in done]), _lists([d[1] for d in done]), pa.array([d[2] for d in done], pa.int32())], names=["_text", "no", "ids", "head", "sync"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, sync = None, array("i"), 0
        one = lambda: pa.RecordBatch.from_arrays([pa.array([at]), _lists([out])], names=["_text", "ids"])
        for batch in batches:
            for r, key in enumerate(batch.column(0).to_pylist()):
                if key != at:
                    if at is not None:
                        yield one()
                    at, out, sync = key, array("i"), 0
                ids = array("i", batch.column(2)[r].values.to_numpy().tobytes())
                out.extend(ids[ids_before(array("i", batch.column(3)[r].values.to_numpy().tobytes()), sync) :])
                sync = batch.column(4)[r].as_py()
        if at is not None:
            yield one()

    keyed = docs.select(F.sha2(F.col(text).cast("binary"), 256).alias("_text"), text)
    dealt = keyed.mapInArrow(split, "_text string, no int, cut int, chunk string").groupBy("_text", "no").agg(F.first("cut").alias("cut"), F.first("chunk").alias("chunk"))
    done = map_batches(dealt, pieces, "_text string, no int, ids array<int>, head array<int>, sync int")
    return done.repartition("_text").sortWithinPartitions("_text", "no").mapInArrow(stitch, "_text string, ids array<int>")


def encode(docs: DataFrame, file: RankFile, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): one row per row of ``docs``, the ids of its whole text as the tiktoken library's encode_ordinary.

    Null and empty texts have no ids. Texts of any length and kind are encoded whole, with runs of millions of equal characters.
    Repeated rows and repeated keys give rows of their own; other columns are not read; an empty table gives no rows.
    """
    bounded(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    long = F.coalesce(F.length(text) > SPREAD, F.lit(False))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(file)
        return pa.RecordBatch.from_arrays([batch.column(0), _lists([own.encode(t or "") for t in batch.column(1).to_pylist()])], names=[key, "ids"])

    short = map_batches(docs.where(~long).select(key, text), whole, f"`{key}` {kind}, ids array<int>")
    far = docs.where(long).select(key, F.sha2(F.col(text).cast("binary"), 256).alias("_text"))
    return short.unionByName(far.join(_spread(docs.where(long), file, text), "_text").select(key, "ids"))


def decode(encoded: DataFrame, file: RankFile, ids: str = "ids") -> DataFrame:
    """``encoded`` with its ids' bytes as column ``decoded``; null ids give no bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, col = coder(file), batch.column(batch.schema.get_field_index(ids))
        back = [own.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in col]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=[*batch.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructType

    return map_batches(encoded, run, StructType([*encoded.schema.fields]).add("decoded", BinaryType()))


def digests(docs: DataFrame, file: RankFile, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256): an encoding and its way back, per row of ``docs``."""
    both = decode(encode(docs, file, key, text), file)
    joined = F.array_join("ids", ",").cast("binary")
    return both.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
