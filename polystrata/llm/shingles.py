"""Word shingles as 64-bit hashes and their universal-hash minima, in numpy over the bytes of a text."""

from __future__ import annotations

import hashlib

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_UP = np.arange(65, 91)
_BYTE[_UP] = _BYTE[_UP + 32]  # A-Z hash as a-z
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 2048
_pow = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 64)
        with np.errstate(over="ignore"):
            _pow = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE))])
    return _pow


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word [^\\x20\\x09-\\x0D]+, ASCII case folded."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    sep = _SEP[raw]
    inside = ~sep
    if not inside.any():
        return np.empty(0, np.uint64)
    first = inside.copy()
    first[1:] &= sep[:-1]
    kept = raw[inside]
    starts = np.flatnonzero(first[inside])
    lengths = np.diff(np.append(starts, len(kept)))
    place = np.arange(len(kept)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[kept] * _powers(int(lengths.max()))[place], starts)
        return mix(sums + lengths.astype(np.uint64) * _MUL)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word runs; with fewer words the whole sequence is one; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(k, len(w))
    with np.errstate(over="ignore"):
        acc = mix(w[: len(w) - n + 1] + np.uint64(n))
        for j in range(1, n):
            acc = mix(acc * _MUL + w[j : len(w) - n + 1 + j])
    return np.unique(acc)


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return hashlib.md5(s.tobytes()).digest()


class Minima:
    """The minima of `count` multiply-add-shift functions, a universal family from 64 to 32 bits."""

    def __init__(self, count: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.a = (r.integers(0, 2**63, count, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = r.integers(0, 2**63, count, dtype=np.uint64)

    def of(self, s: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), 2**32 - 1, np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(s), _CHUNK):
                part = self.a[:, None] * s[None, at : at + _CHUNK] + self.b[:, None]
                best = np.minimum(best, (part.min(axis=1) >> np.uint64(32)).astype(np.uint32))
        return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band of `rows` minima; the band's number is part of it."""
    m = sig.reshape(bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        acc = mix(np.arange(1, bands + 1, dtype=np.uint64) * _BASE)
        for j in range(rows):
            acc = mix(acc * _MUL + m[:, j])
    return acc.view(np.int64)
