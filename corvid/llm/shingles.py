"""Hashes of words and word shingles over whole Arrow batches, in numpy."""

from __future__ import annotations

import numpy as np

from corvid.llm.shared import mix

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256) - 1, _BASE, np.uint64)]), dtype=np.uint64)
    return _POWERS


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of texts that lie one after another in raw, and each text's first word."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    starts[inner] |= word[inner]
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, bounds)
    if not len(at):
        return np.zeros(0, np.uint64), first
    low = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    inside = np.flatnonzero(word)
    index = np.cumsum(starts)[inside] - 1
    place = inside - at[index]
    terms = np.zeros(len(raw), np.uint64)
    terms[inside] = (low[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    sums = np.add.reduceat(terms, at)
    sizes = np.bincount(index, minlength=len(at)).astype(np.uint64)
    return mix(sums ^ (sizes * np.uint64(0xD6E8FEB86659FD93))), first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within a text, or of the whole text where it has fewer; bounds by text."""
    sizes = np.diff(first)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(sizes)), counts)
    start = first[:-1][text] + np.arange(bounds[-1]) - bounds[:-1][text]
    end = first[1:][text]
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    total = np.zeros(len(start), np.uint64)
    for k in range(width):
        total = total * np.uint64(0xA0761D6478BD642F) + np.where(start + k < end, padded[start + k], np.uint64(k + 1))
    return mix(total), bounds
