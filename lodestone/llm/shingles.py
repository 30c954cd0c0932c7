"""Word-shingle sets of whole texts as 64-bit hashes, computed over many texts at once with numpy.

Words are the runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A text of fewer words than
the shingle width has its whole sequence as one shingle; no words, no shingles."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _table() -> np.ndarray:
    """A number for each byte, drawn by splitmix64; A-Z share those of a-z."""
    out, x = [], 0x243F6A8885A308D3
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    for b in range(65, 91):
        out[b] = out[b + 32]
    return np.array(out, dtype=np.uint64)


_BYTES = _table()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, dtype=np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, int]:
    """_BASE ** 0..n modulo 2**64, and the inverse of _BASE."""
    global _powers
    if len(_powers) <= n:
        p = np.full(max(n + 1, 1 << 16), _BASE, dtype=np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers, pow(_BASE, -1, 1 << 64)


_inverse = np.ones(1, dtype=np.uint64)


def _inverse_to(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) <= n:
        p = np.full(max(n + 1, 1 << 16), pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        p[0] = 1
        _inverse = np.multiply.accumulate(p)
    return _inverse


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: bytes, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts that lie one after the other in data, and where each text's words begin (and the last end)."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    b = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[b]
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    cut = np.asarray(ends[1:-1], dtype=np.int64)
    cut = cut[cut < n]
    first[cut] = solid[cut]  # a word ends where its text ends
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= space[1:]
    inner = cut[cut > 0] - 1
    last[inner] = solid[inner]
    stops = np.flatnonzero(last) + 1
    powers, _ = _powers_to(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[b] * powers[:n], out=total[1:])
    h = (total[stops] - total[starts]) * _inverse_to(n)[starts]
    h = _mix(h + (stops - starts).astype(np.uint64))
    return h, np.searchsorted(starts, np.asarray(ends, dtype=np.int64), side="left")


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each place at which `width` words begin; the whole sequence if there are fewer words."""
    n = len(words)
    if not n:
        return words
    size = min(width, n)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = _mix(h * np.uint64(0x9DDFEA08EB382D69) + words[k : n - size + 1 + k])
    return h


def sets(data: bytes, ends: list[int], width: int):
    """For each text, the sorted distinct hashes of its shingles."""
    words, at = word_hashes(data, ends)
    if not len(words):
        for _ in range(len(ends) - 1):
            yield words
        return
    counts = np.diff(at)
    h = shingle_hashes(words, width) if len(words) >= width else None  # those that cross texts are not used
    for k, n in enumerate(counts.tolist()):
        lo = int(at[k])
        if n >= width:
            x = np.sort(h[lo : lo + n - width + 1])
        else:
            x = np.sort(shingle_hashes(words[lo : lo + n], width))
        if len(x) > 1:
            keep = np.empty(len(x), dtype=bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        yield x
