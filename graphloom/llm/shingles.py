"""Sets of word shingles as sorted arrays of 64-bit hashes, many texts at a time in NumPy."""

from __future__ import annotations

import numpy as np

from graphloom.llm.common import mix64, slices

WORDS = 5
SLICE = 1 << 20
#: 64-bit hashes stand for shingles and for sets. Two unequal ones among a thousand million collide with probability 0.03.
_SEED = 0x9E3779B97F4A7C15


def _tables():
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return lower, space


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _SEED, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); words are runs without white space, A-Z lower-cased."""
    lower, space = _tables()
    data = lower[data]
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    edge[-1] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    after = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    longest = int(length.max())
    terms = (data[inside].astype(np.uint64) + np.uint64(1)) * _powers(longest)[place]
    h = mix64(np.add.reduceat(terms, first) + length.astype(np.uint64))
    counts = np.diff(np.searchsorted(start, offsets))
    return h, counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """A sorted array of distinct shingle hashes for each text; a text of fewer words has its whole sequence as one."""
    for i, j in slices(offsets, SLICE):
        words, counts = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = len(words) - WORDS + 1
        if n > 0:
            grams = words[:n].copy()
            for k in range(1, WORDS):
                grams = mix64(grams) + words[k : k + n]
            grams = mix64(grams)
        at = 0
        for c in counts.tolist():
            if c >= WORDS:
                own = np.sort(grams[at : at + c - WORDS + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
            elif c:
                h = np.array([_SEED + c], np.uint64)
                for w in words[at : at + c]:
                    h = mix64(h + w)
                yield h
            else:
                yield np.empty(0, np.uint64)
            at += c


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """One signed 64-bit name for each set, the same for equal sets; 0 for the empty set."""
    out = np.zeros(len(sets), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            out[i] = mix64(s + np.uint64(_SEED)).sum(dtype=np.uint64) + np.uint64(len(s))
    return mix64(out).view(np.int64)
