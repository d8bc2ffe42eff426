"""Word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_WORDS: dict[bytes, int] = {}
_MOST_WORDS = 100_000
_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased (bytes split and lower-case at exactly these)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(_WORDS) > _MOST_WORDS:
        _WORDS.clear()
    get, digest, out = _WORDS.get, xxhash.xxh3_64_intdigest, []
    for w in words:
        h = get(w)
        if h is None:
            h = _WORDS[w] = digest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence where it is shorter; none without words."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    w = word_hashes(text)
    n = len(w)
    if n == 0:
        return w
    size = min(n, k)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = _mix(h + w[i : n - size + 1 + i] * _M[i % len(_M)])
    return np.unique(h)


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit identity of a set of hashes; with the set's size it names a class of equal sets."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes()))))
