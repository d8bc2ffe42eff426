"""Byte-level BPE over a bounded memo of distinct pre-tokens.

A text is cut into the tokenizer's own pre-tokens; the pieces of a pre-token depend on nothing around it, so each distinct one is
encoded once while it stays in the memo. Pre-tokens of any length are encoded, such as a million spaces.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

END_OF_TEXT = "<|endoftext|>"
#: Letters, numbers and white space up to here are the same in every version of Unicode; text with other characters is cut by
#: the library that reads the .json file, whose tables count.
_LAST = 0x24F
_OTHER = re.compile(f"[^\x00-{chr(_LAST)}]")
#: Pre-tokens of more characters are encoded by that library, whose merges take no more than n log n steps, and are not kept.
LONG = 64
#: Characters after which a text may be cut; a cut lies between a character that is no white space and one that is.
SLAB = 1 << 20
_CUT = re.compile(r"\S(?=[ \n\t])")


def _ranges(holds: Callable[[str], bool]) -> str:
    fits = [holds(chr(c)) for c in range(_LAST + 1)] + [False]
    starts = [c for c in range(_LAST + 1) if fits[c] and not (c and fits[c - 1])]
    return "".join(f"\\u{c:04x}-\\u{next(e for e in range(c, _LAST + 2) if not fits[e]) - 1:04x}" for c in starts)


def latin_pattern(pattern: str) -> re.Pattern:
    """The pre-tokenizer's pattern with its Unicode classes written out for characters up to U+024F."""
    kinds = {
        r"\p{L}": _ranges(lambda c: unicodedata.category(c)[0] == "L"),
        r"\p{N}": _ranges(lambda c: unicodedata.category(c)[0] == "N"),
        r"\s": r"\t-\r \x85\xa0",
    }
    out, inside = [], False
    for part in re.split(r"(\\p\{\w\}|\\[sS]|\[\^?|\])", pattern):
        if part == r"\S":
            part = f"[^{kinds[chr(92) + 's']}]"
        elif part in kinds:
            part = kinds[part] if inside else f"[{kinds[part]}]"
        elif part[:1] == "[" or part == "]":
            inside = part != "]"
        out.append(part)
    return re.compile("".join(out))


def slabs(text: str) -> Iterator[str]:
    """Consecutive parts of a text, cut where a pre-token ends; a part without such a place stays whole."""
    at = 0
    while len(text) - at > SLAB and (m := _CUT.search(text, at + SLAB)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


class Encoder:
    """Ids as the tokenizers library gives them for the .json file, special strings inside texts included.

    ``json_path`` and ``ranks_path`` hold the same vocabulary. At most ``memo`` distinct pre-tokens are remembered in each of
    two generations; those not seen for one generation are forgotten, so memory is bounded and results do not change.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, make: Callable[[list[int]], object], memo: int = 100_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._piece = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._library = Tokenizer.from_file(json_path)
        self._latin = latin_pattern(pattern).findall
        self._memo: dict[str, object] = {}
        self._old: dict[str, object] = {}
        self._make, self._max = make, memo

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text in order, some at a time; END_OF_TEXT is one by itself."""
        for i, part in enumerate(text.split(END_OF_TEXT)):
            if i:
                yield [END_OF_TEXT]
            for slab in slabs(part):
                if slab.isascii() or _OTHER.search(slab) is None:
                    yield self._latin(slab)
                else:
                    yield [slab[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(slab)]

    def value(self, pre: str) -> object:
        """What ``make`` gives for the ids of a pre-token."""
        value = self._memo.get(pre)
        if value is not None:
            return value
        value = self._old.pop(pre, None)
        if value is None:
            short = len(pre) <= LONG and pre != END_OF_TEXT
            value = self._make(self._piece(pre.encode()) if short else self._library.encode(pre, add_special_tokens=False).ids)
        if len(pre) <= LONG:
            if len(self._memo) >= self._max:
                self._old, self._memo = self._memo, {}
            self._memo[pre] = value
        return value

    def values(self, text: str) -> list[object]:
        """What ``make`` gives for each pre-token of the text."""
        get, own = self._memo.get, self.value
        out: list[object] = []
        for pres in self.pre_tokens(text):
            out += [get(p) or own(p) for p in pres]
        return out


def piece_counter(json_path: str, ranks_path: str, pattern: str, memo: int = 200_000) -> Encoder:
    """An encoder that keeps only how many pieces a pre-token has."""
    return Encoder(json_path, ranks_path, pattern, len, memo)


def id_encoder(json_path: str, ranks_path: str, pattern: str, memo: int = 100_000) -> Encoder:
    """An encoder that keeps a pre-token's ids as little-endian unsigned 32-bit integers."""
    return Encoder(json_path, ranks_path, pattern, _as_bytes, memo)


def _as_bytes(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()
