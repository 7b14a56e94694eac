"""Words, shingles and their hashes, of whole texts as UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import xxhash

P = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33, ONE = np.uint64(33), np.uint64(1)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space, as bytes methods do."""
    return text.lower().split() if text else []


def shingle_set(text: bytes | None, k: int) -> set:
    w = words(text)
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)} if w else set()


def word_hashes(w: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, w)), ">u8").astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """63 well mixed bits of each number."""
    h = (h ^ (h >> S33)) * M1
    h = (h ^ (h >> S33)) * M2
    return (h ^ (h >> S33)) >> ONE


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a sequence of word hashes; of the whole one if it is shorter."""
    k = min(k, len(h))
    if not k:
        return h
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * P + h[i : len(h) - k + 1 + i]
    return mixed(out + np.uint64(k))


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles, as signed numbers that are not negative."""
    return np.unique(windows(word_hashes(words(text)), k)).view(np.int64)


def jaccard(a: set, b: set) -> tuple[int, int]:
    """Sizes of intersection and union."""
    both = len(a & b)
    return both, len(a) + len(b) - both
