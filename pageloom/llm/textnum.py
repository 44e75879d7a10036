"""Texts as numbers: vectorised word and shingle hashes over UTF-8 bytes (numpy, on executors)."""

from __future__ import annotations

import numpy as np

from .common import ship

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n or more of them."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        for out, step in ((up, _BASE), (down, pow(_BASE, -1, 1 << 64))):
            out[0], filled = 1, 1
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * np.uint64(pow(step, filled, 1 << 64))
                filled *= 2
        if size <= 4 * _BLOCK:
            _powers[size] = up, down
        return up, down
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _block_words(raw: np.ndarray) -> np.ndarray:
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word [^\\x20\\x09-\\x0D]+, A-Z lower-cased, in order. Long texts go by blocks that end at a separator."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= _BLOCK:
        return _block_words(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + _BLOCK, len(raw))
        while end < len(raw):
            found = np.flatnonzero(_SPACE[raw[end : end + _BLOCK]])
            if len(found):
                end += int(found[0])
                break
            end = min(end + _BLOCK, len(raw))
        parts.append(_block_words(raw[at:end]))
        at = end
    return np.concatenate(parts)


_STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of a shorter text, its whole sequence as one; empty without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    out = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        out += w[k : k + len(out)] * _STEPS[k]
    return np.unique(mix(out))


ship(__name__)
