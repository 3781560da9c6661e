"""Hashes of words and word shingles, in numpy."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

WIDTH = 5
_rng = np.random.default_rng(20240501)
#: Odd multipliers, one for each place in a shingle.
PLACES = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one finaliser on 64-bit integers: alternating shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """Of the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased. bytes.lower and bytes.split know exactly these."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxh64_intdigest, found), dtype=np.uint64, count=len(found))


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """Of every shingle in order, repeats included; fewer words than the width are one shingle; no words, none."""
    h = word_hashes(text)
    n = len(h)
    if n < width:
        return mixed(np.array([sum(int(x) * int(PLACES[k]) for k, x in enumerate(h)) + n & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)) if n else np.zeros(0, np.uint64)
    out = h[: n - width + 1] * PLACES[0]
    for k in range(1, width):
        out += h[k : n - width + 1 + k] * PLACES[k]
    return mixed(out)
