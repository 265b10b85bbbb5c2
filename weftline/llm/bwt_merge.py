"""Merging of Burrows-Wheeler transforms by iterative interleave refinement.

Kept as the tried way for repeated strings (the README has its figures); op3 decides the same question by minimizers. A
shard's transform lists, in the order of all suffixes, the byte before each; texts end in a terminator below all bytes, and
equal terminators go by shard and text. Merging never sorts suffixes again: the interleave says which shard each suffix
comes from, and each round puts it in the order of one more leading byte, by a stable distribution of the previous one. Where a
block first splits in round k, the common prefix with the suffix before has k - 1 bytes.
"""

from __future__ import annotations

import numpy as np


def transform(texts: list[bytes]) -> np.ndarray:
    """Of a small shard, by sorting its suffixes; symbols are bytes + 1, the terminator 0."""
    rows = sorted((t[i:] + b"", k, i) for k, t in enumerate(texts) for i in range(len(t) + 1))
    return np.array([texts[k][i - 1] + 1 if i else 0 for _, k, i in rows], dtype=np.uint16)


def merge(a: np.ndarray, b: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(merged transform, interleave, common prefixes up to depth, rounds): suffixes alike over depth bytes may stay unordered."""
    z = np.concatenate([np.zeros(len(a), dtype=np.uint8), np.ones(len(b), dtype=np.uint8)])
    lcp = np.full(len(z), depth, dtype=np.int32)
    block = np.zeros(len(z), dtype=np.int64)
    lcp[0] = 0
    ends = np.repeat(np.array([0, 1], dtype=np.uint8), [int((a == 0).sum()), int((b == 0).sum())])  # the empty suffixes keep their order

    def symbols(z):
        out = np.empty(len(z), dtype=np.uint16)
        out[z == 0], out[z == 1] = a, b
        return out

    for k in range(1, depth + 1):
        s = symbols(z)
        order = np.argsort(s, kind="stable")
        new, come, first = z[order], block[order], s[order]
        new[: len(ends)] = ends
        # A new block begins where the first byte or the block of the rest differs; each terminator is its own.
        begins = np.append(True, (first[1:] != first[:-1]) | (come[1:] != come[:-1]) | (first[1:] == 0))
        lcp[begins & (lcp >= k)] = k - 1
        lcp[0] = 0
        now = np.cumsum(begins)
        if np.array_equal(new, z) and now[-1] == len(z):
            return symbols(new), new, lcp, k
        z, block = new, now
    return symbols(z), z, lcp, depth
