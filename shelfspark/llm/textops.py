"""Words, lines and shingles of byte strings, vectorised with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D. UTF-8 keeps
those five bytes out of longer sequences, so this equals `[^\\x20\\x09-\\x0D]+`
over code points.
"""

from __future__ import annotations

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: Whether a byte begins a code point.
_STARTS = np.ones(256, bool)
_STARTS[0x80:0xC0] = False

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
        done += step
    return out


#: Bytes that are hashed at a time, unless one word is longer.
PIECE = 1 << 16
_POW, _INV = _powers(_BASE, 2 * PIECE), _powers(_BASE_INVERSE, 2 * PIECE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POW):
        return _powers(_BASE, n), _powers(_BASE_INVERSE, n)
    return _POW[:n], _INV[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word."""
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_IS_SPACE[raw]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.empty(0, np.uint64)
    return span_hashes(raw, starts, ends)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ascending spans. They don't depend on where a span stands, so a long text goes piece by piece."""
    if len(raw) <= 2 * PIECE:
        return _span_hashes(raw, starts, ends)
    cuts = np.searchsorted(starts, np.arange(0, len(raw) + PIECE, PIECE))
    out = [np.empty(0, np.uint64)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a < b:
            base, end = starts[a], ends[b - 1]
            out.append(_span_hashes(raw[base:end], starts[a:b] - base, ends[a:b] - base))
    return np.concatenate(out)


def _span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _U(0xD6E8FEB86659FD93) + mix(words[i : i + n] + _U(i + 1))
    return mix(out)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct window hashes, ascending; a shorter text counts as one window; without words, none."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(width, len(words))))
