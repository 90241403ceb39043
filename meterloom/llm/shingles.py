"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & _MASK)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


def word_hashes(texts: list[str | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and the number of words up to each text's begin.

    Words are runs of anything but ASCII white space, A-Z in lower case. A word's
    hash is its polynomial in the byte values, mixed with its length.
    """
    data = b"\n".join([(t or "").encode() for t in texts]) + b"\n"
    raw = np.frombuffer(data.lower(), np.uint8)
    space = _ASCII_SPACE[raw]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    terms = np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw) - 1))))
    h = (terms[ends] - terms[begins]) * _powers(_INVERSE, len(raw))[begins]
    h = mixed(h ^ ((ends - begins).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), seed)
    lengths = np.array([len((t or "").encode()) + 1 for t in texts])
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return h, np.searchsorted(begins, starts)


def short_set(words: np.ndarray) -> np.ndarray:
    """The set of a text with fewer words than a shingle: all of them as one, or nothing."""
    one = np.zeros(min(1, len(words)), np.uint64)
    for i in range(len(words)):
        one = mixed(one + words[i : i + 1] * np.uint64(2 * i + 1), 100 + i)
    return one


def shingle_sets(texts: list[str | None], n: int, seed: int = 0) -> list[np.ndarray]:
    """Each text's distinct shingles of n words, sorted; fewer words are one shingle, none give an empty set."""
    h, starts = word_hashes(texts, seed)
    k = max(0, len(h) - n + 1)
    joined = np.zeros(k, np.uint64)
    for i in range(n):
        joined = mixed(joined + h[i : i + k] * np.uint64(2 * i + 1), i + 1)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(joined[a : b - n + 1]))
        else:
            out.append(short_set(h[a:b]))
    return out
