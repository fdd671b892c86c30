"""Words and word shingles of a text as 64-bit hashes, for the operators that compare texts by them."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a whole text's words: A-Z lower-cased, runs of characters that are no ASCII white space."""
    words = text.encode("utf-8").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


#: Odd multipliers, one for each place in a shingle.
_PLACE = mix64(np.arange(1, 257, dtype=U)) | U(1)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; none if there are fewer than k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    total = np.zeros(n, U)
    for j in range(k):
        total += words[j : j + n] * _PLACE[j]
    return mix64(total)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of k words; with fewer words the whole sequence is one; without words none."""
    n = len(words)
    if n == 0:
        return np.empty(0, U)
    if n < k:
        return mix64(grams(words, n) + U(n))
    return np.unique(grams(words, k))
