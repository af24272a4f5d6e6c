"""Word-shingle sets of texts as sorted 64-bit numbers, computed for many texts at once.

A word's number is a polynomial of its bytes, a shingle's a mix of its words' numbers; equal
word sequences give equal numbers on every machine. Two of the at most some 10^5 shingles that
are compared at once collide with a chance below 10^-9.
"""

from __future__ import annotations

import functools

import numpy as np

#: White space to a space, A-Z to a-z.
FOLD = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE = 0x9E3779B97F4A7C15
#: Bytes hashed in one step.
SLICE = 1 << 19


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole number."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _weights(size: int) -> list[np.uint64]:
    return [np.uint64(int(mix(np.array([j + 1], np.uint64))[0]) | 1) for j in range(size)]


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words of all texts in order, and where each text's words begin (one more entry)."""
    data = np.frombuffer(b" " + b"\n".join(texts).translate(FOLD) + b" ", np.uint8)
    gap = data == 32
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    first = np.searchsorted(start, np.cumsum([1] + [len(t) + 1 for t in texts]))
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + SLICE)))
        lo, hi = int(start[a]), int(end[b - 1])
        power, inverse = _powers(max(2 * SLICE, 1 << (hi - lo).bit_length()))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        out[a:b] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        a = b
    return out, first


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Of each text the sorted distinct shingles of ``size`` words; with fewer words, the whole sequence as one."""
    words, first = word_numbers(texts)
    weights = _weights(size)
    n = max(0, len(words) - size + 1)
    all_sums = np.zeros(n, np.uint64)
    for j, w in enumerate(weights):
        all_sums += words[j : j + n] * w
    all_sums = mix(all_sums)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(all_sums[lo : hi - size + 1]))
        elif hi > lo:
            few = sum((words[lo + j : lo + j + 1] * weights[j] for j in range(hi - lo)), np.zeros(1, np.uint64))
            out.append(mix(few + np.uint64(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
