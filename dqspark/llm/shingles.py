"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Words(dict):
    """Hashes of words, remembered as long as there are few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int, words: Words) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``k`` words, or of all words if there are fewer.

    Words are what ASCII white space separates, with A to Z lower-cased. Without words the set is empty.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([words[w] for w in found], dtype=np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h) if len(h) < k else k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(h))):
            out = mix(out * _ODD[0] + h[i:i + n])
    return np.unique(out)
