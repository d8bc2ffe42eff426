"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the model's pieces reads a text once; at each position its output links give every piece that
ends there, longest first, and each relaxes the best score of that position (Viterbi). Characters that no piece covers fall
back to the model's byte pieces, or to unk. Long stretches are solved part by part: the best path passes every place that no piece
crosses, and scores and back links are typed arrays of one part. Where no piece has the space mark after another character, the best path passes
every place before a run of marks, so texts are cut there and each distinct chunk is solved once while it stays in a bounded memo.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import map_batches

MARK = "▁"
UNK_PENALTY = 10.0
MEMO, LONG = 200_000, 64
#: Characters that are solved together.
SLAB = 1 << 18


@dataclass(frozen=True)
class PieceModel:
    """Pieces in id order: text, score, kind (1 normal, 2 unk, 3 control, 4 user-defined, 6 byte)."""

    path: str


class Codec:
    """Best-scoring segmentation for one model file whose normalizer is the identity with a dummy prefix."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only models with an identity normalizer and a dummy prefix are read")
        self._auto, self._bytes, self.unk, worst, inner = ahocorasick.Automaton(), [0] * 256, 0, 0.0, False
        self._longest = max((len(p.piece) for p in model.pieces), default=1)
        self._out: list[bytes] = []
        for i, p in enumerate(model.pieces):
            self._out.append(b"")
            if p.type in (1, 4):
                self._auto.add_word(p.piece, (len(p.piece), i, p.score))
                self._out[i] = p.piece.replace(MARK, " ").encode()
                worst = min(worst, p.score)
                inner |= MARK in p.piece.lstrip(MARK)
            elif p.type == 6:
                self._bytes[int(p.piece[3:5], 16)] = i
                self._out[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:
                self.unk = i
                self._out[i] = model.trainer_spec.unk_surface.encode()
        self._auto.make_automaton()
        self._fallback, self._cut = model.trainer_spec.byte_fallback, not inner
        self._unk_score = worst - UNK_PENALTY
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def viterbi(self, s: str) -> list[int]:
        """Ids of the best path over a string whose spaces are marks already; the first found wins a tie."""
        if len(s) <= SLAB:
            return self._solve(s)
        out: list[int] = []
        at, size = 0, SLAB
        while at < len(s):
            part = s[at : at + size]
            end = len(part) if at + size >= len(s) else self._last_cut(part)
            if not end:  # pieces cross every place so far: look further
                size *= 2
                continue
            ids = self._solve(part[:end])
            if not self._fallback and out and ids and out[-1] == ids[0] == self.unk:
                ids = ids[1:]  # a run of unknown characters is one unk
            out += ids
            at, size = at + end, SLAB
        return out

    def _last_cut(self, part: str) -> int:
        """The last place at least one longest piece before the end of ``part`` that no piece crosses; 0 if there is none."""
        crossed = np.zeros(len(part) + 1, dtype=np.int32)
        for last, (size, _, _) in self._auto.iter(part):
            crossed[last + 2 - size] += 1
            crossed[last + 1] -= 1
        free = np.flatnonzero(np.cumsum(crossed[: max(1, len(part) - self._longest)]) == 0)
        return int(free[-1]) if len(free) else 0

    def _solve(self, s: str) -> list[int]:
        n = len(s)
        best, size_of, id_of = array("d", [-np.inf]) * (n + 1), array("H", [1]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0], done, unk = 0.0, 0, self._unk_score
        single = bytearray(n)
        for end, (size, i, score) in self._auto.iter(s):
            while done < end:  # positions before this match are settled; a character without its own piece may be unknown
                if not single[done] and best[done] + unk > best[done + 1]:
                    best[done + 1], size_of[done + 1], id_of[done + 1] = best[done] + unk, 1, -1
                done += 1
            if size == 1:
                single[end] = 1
            now = best[end + 1 - size] + score
            if now > best[end + 1]:
                best[end + 1], size_of[end + 1], id_of[end + 1] = now, size, i
        while done < n:
            if not single[done] and best[done] + unk > best[done + 1]:
                best[done + 1], size_of[done + 1], id_of[done + 1] = best[done] + unk, 1, -1
            done += 1
        out: list[int] = []
        at = n
        while at:
            start, i = at - size_of[at], id_of[at]
            if i >= 0:
                out.append(i)
            elif self._fallback:
                out += [self._bytes[b] for b in reversed(s[start:at].encode("utf-8", "replace"))]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
            at = start
        out.reverse()
        return out

    def _chunk(self, chunk: str) -> bytes:
        ids = self._old.pop(chunk, None) or np.array(self.viterbi(chunk), dtype="<u4").tobytes()
        if len(chunk) <= LONG:
            if len(self._memo) >= MEMO:
                self._old, self._memo = self._memo, {}
            self._memo[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for null and empty texts."""
        if not text:
            return b""
        if not self._cut or not self._fallback or MARK in text:
            return np.array(self.viterbi(MARK + text.replace(" ", MARK)), dtype="<u4").tobytes()
        parts = text.split(" ")
        if "" in parts:
            merged, run = [], ""
            for p in parts:
                run += MARK + p
                if p:
                    merged.append(run)
                    run = ""
            parts = [*merged, run] if run else merged
        else:
            parts = [MARK + p for p in parts]
        get, own = self._memo.get, self._chunk
        return b"".join([get(p) or own(p) for p in parts])

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, bytes decoded (broken ones as U+FFFD), the dummy prefix removed."""
        out = self._out
        text = b"".join([out[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def codec(model: PieceModel) -> Codec:
    if model.path not in _CODECS:
        _CODECS[model.path] = Codec(model.path)
    return _CODECS[model.path]


def _rows(docs: DataFrame, column: str, name: str, kind: str, f, carry: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = f(batch.column(len(carry)).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *found], names=[*carry, *name.split(",")])

    return map_batches(docs.select(*carry, column), run, schema + ", " + ", ".join(f"{n} {k}" for n, k in zip(name.split(","), kind.split(","), strict=True)))


def encode(docs: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, ids (array of int; empty for null and empty texts). Whole texts; repeated rows are encoded each."""
    to_ids = lambda texts: [pa.array([np.frombuffer(codec(model).encode(t), dtype="<u4").astype(np.int32) for t in texts], pa.list_(pa.int32()))]
    return _rows(docs, text, "ids", "array<int>", to_ids, [key])


def decode(encoded: DataFrame, model: PieceModel, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row: key, text (empty for null and empty ids)."""
    to_text = lambda rows: [pa.array([codec(model).decode(np.asarray(r or [], dtype="<u4").tobytes()) for r in rows], pa.string())]
    return _rows(encoded, ids, "text", "string", to_text, [key])


def digest(docs: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, n_pieces, ids_crc32, decoded_sha256, round_trip (decoding gives the text back; a text that holds
    U+2581 itself does not). One pass encodes and decodes, so ids never leave the task."""
    import hashlib
    import zlib

    def run(texts: list[str | None]) -> list[pa.Array]:
        c = codec(model)
        ids = [c.encode(t) for t in texts]
        back = [c.decode(i) for i in ids]
        return [
            pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array([zlib.crc32(i) for i in ids], pa.int64()),
            pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
            pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)], pa.bool_()),
        ]

    return _rows(docs, text, "n_pieces,ids_crc32,decoded_sha256,round_trip", "long,long,string,boolean", run, [key])
