"""Sets of hashed word shingles, computed for a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np

from querygrade.llm.common import mix64, random64

WORDS = 5
_BYTE = random64(256, 1)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0  # separators
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_PLACE = random64(WORDS, 2)
_LENGTH = random64(WORDS + 1, 3)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; they grow to the longest buffer met."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, and the number of words before each text."""
    if len(body) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    up, down = _power(len(body))
    value = _BYTE[body]
    inside = value != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(body)]
    first[heads] |= inside[heads]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    sums = np.add.reduceat(value * up[: len(body)], starts)
    return mix64(sums * down[starts]), np.searchsorted(starts, bounds)


def shingle_sets(body: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order; shorter texts are one shingle, or none."""
    words, before = word_hashes(body, bounds)
    if len(words) >= WORDS:
        runs = words[: len(words) - WORDS + 1] * _PLACE[0]
        for k in range(1, WORDS):
            runs = runs + words[k : len(words) - WORDS + 1 + k] * _PLACE[k]
        runs = mix64(runs + _LENGTH[WORDS])
    sets = []
    for start, stop in zip(before[:-1].tolist(), before[1:].tolist()):
        n = stop - start
        if n >= WORDS:
            own = np.sort(runs[start : stop - WORDS + 1])
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif n:
            sets.append(mix64((words[start:stop] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _LENGTH[n]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_key(own: np.ndarray) -> int:
    """An order-free 63-bit name of a set."""
    total = mix64(own ^ _PLACE[1]).sum(dtype=np.uint64, keepdims=True) + np.array([len(own)], np.uint64)
    return int(mix64(total)[0] >> np.uint64(1))
