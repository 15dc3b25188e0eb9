"""Hashes of a text's word shingles."""

from __future__ import annotations

import numpy as np


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """A 64-bit hash of each word shingle, in order; of all words if there are fewer than the shingle has."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    h64 = xxhash.xxh64_intdigest
    return np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=n)


def class_hash(h: np.ndarray) -> int:
    """A hash of a sorted set of hashes: equal sets are one class of texts."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))
