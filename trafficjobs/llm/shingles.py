"""Distinct word-shingle sets of whole texts as sorted 64-bit hashes, vectorised over the rows of a batch."""

from __future__ import annotations

import numpy as np

from trafficjobs.llm.common import mix

WORDS = 5
_BASE = np.uint64(0x100000001B3 * 0x9E3779B1 % 2**64 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: np.uint64, name: str) -> np.ndarray:
    """base to the powers 0 to n-1, modulo 2^64."""
    if name not in _powers or len(_powers[name]) < n:
        row = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        row[0] = 1
        _powers[name] = np.multiply.accumulate(row)
    return _powers[name][:n]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs outside ASCII white space, A-Z lower-cased) and each row's first word index, with an end."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    before = np.concatenate(([True], space[:-1]))
    before[offsets[:-1][filled]] = True
    after = np.concatenate((space[1:], [True]))
    after[offsets[1:][filled] - 1] = True
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space)
    sums = np.cumsum(_LOWER[raw] * _power(n, _BASE, "up"), dtype=np.uint64)
    left = np.where(start > 0, sums[start - 1], np.uint64(0))
    words = (sums[end] - left) * _power(n, _BACK, "down")[start]
    return mix(words + (end - start + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), np.searchsorted(start, offsets)


def _joined(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """One hash for the k words from each position on."""
    out = np.full(len(at), np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + words[at + i]
    return mix(out)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, sorted, one row after the other, and their offsets. With fewer words than size the whole sequence is one."""
    words, first = word_hashes(raw, offsets)
    counts = np.diff(first)
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.concatenate(([0], np.cumsum(each)))
    out = np.empty(ends[-1], dtype=np.uint64)
    if len(words) >= size:
        row = np.repeat(np.arange(len(counts)), np.where(counts >= size, each, 0))
        slot = np.concatenate([[0], np.cumsum(np.where(counts >= size, each, 0))])
        inner = np.arange(slot[-1]) - slot[row]
        out[ends[row] + inner] = _joined(words, first[row] + inner, size)
    for k in range(1, size):
        rows = np.flatnonzero(counts == k)
        out[ends[rows]] = _joined(words, first[rows], k)
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if hi - lo > 1:
            out[lo:hi].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[ends[:-1][each > 0]] = True
    return out[fresh], np.concatenate(([0], np.cumsum(fresh)))[ends]
