"""Merged transforms against the transform of the union, and common prefixes against the suffixes themselves."""

import random

from weftline.llm.bwt_merge import merge, transform


def test_merge():
    rng = random.Random(4)
    for _ in range(20):
        shards = [["".join(rng.choices("ab", k=rng.randint(0, 12))).encode() for _ in range(rng.randint(1, 4))] for _ in range(2)]
        got, _, lcp, _ = merge(transform(shards[0]), transform(shards[1]), 40)
        assert got.tolist() == transform(shards[0] + shards[1]).tolist()
        suffixes = sorted((t[i:], k) for k, t in enumerate(shards[0] + shards[1]) for i in range(len(t) + 1))
        common = [0] + [next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))) for (x, _), (y, _) in zip(suffixes, suffixes[1:])]
        assert lcp.tolist() == common
