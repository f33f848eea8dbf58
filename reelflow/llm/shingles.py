"""Sets of five-word shingles as sorted 64-bit hashes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import xxhash

SHINGLE_WORDS = 5
#: A worker's word hashes are forgotten beyond this many, so that they stay small.
CACHED_WORDS = 1 << 19


class WordHashes(dict):
    """Word -> 64-bit hash, computed at first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: bytes | None) -> list[bytes]:
    """Words between space, tab, line feed, vertical tab, form feed and return; only A-Z are lowered."""
    return text.lower().split() if text else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes | None, hashes: WordHashes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of all words as one where there are fewer than `size`."""
    found = words(text)
    if not found:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(size, len(h))
    out = h[: len(h) - size + 1]
    for k in range(1, size):
        out = _mix(out) + h[k : len(h) - size + 1 + k]
    return np.unique(_mix(out + np.uint64(size)).view(np.int64))


def digest(values: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return blake2b(values.tobytes(), digest_size=16).digest()
