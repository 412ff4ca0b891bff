"""Shingle sets and min-max signatures of texts, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

SHINGLE = 5
#: Hash evaluations; each gives a minimum and a maximum, so the signature is twice as long.
EVALUATIONS, BANDS, ROWS = 50, 20, 5
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_rng = np.random.default_rng(7)
_POWERS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(1, 1 << 63, EVALUATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, EVALUATIONS, dtype=np.uint64)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
#: The multipliers of a public 64-bit finaliser.
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_CHUNK = 4096


class Words(dict):
    """Word to hash; emptied when it has grown to a bound."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, known: Words) -> np.ndarray:
    """Sorted distinct hashes of the windows of five words; of the whole sequence if there are fewer words."""
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    k = min(n, SHINGLE)
    out = h[: n - k + 1] * _POWERS[0]
    for i in range(1, k):
        out += h[i : n - k + 1 + i] * _POWERS[i]
    return np.unique(mixed(out + np.uint64(SHINGLE - k)))


def fingerprint(own: np.ndarray) -> bytes:
    """Of a set: equal for equal sets alone."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def signature(own: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, side by side."""
    out = np.empty((EVALUATIONS, 2), np.uint64)
    for at in range(0, len(own), _CHUNK):
        x = np.multiply.outer(_A, own[at : at + _CHUNK])
        x += _B[:, None]
        low, high = x.min(1), x.max(1)
        if at:
            np.minimum(out[:, 0], low, out=out[:, 0])
            np.maximum(out[:, 1], high, out=out[:, 1])
        else:
            out[:, 0], out[:, 1] = low, high
    return out.ravel()


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of so many values (a divisor of the signature's length); equal bands of two signatures give equal hashes."""
    return mixed((mixed(sig).reshape(-1, rows) * _BAND.reshape(-1, rows)).sum(1, dtype=np.uint64)).view(np.int64)
