"""Column expressions that Spark lacks: log-gamma, log Bessel I0, log-sum-exp, counter-based random numbers, grids."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_EPS = 1e-30
LN_2PI = math.log(2 * math.pi)
#: The series of ln Gamma after a shift by 8, and the small-argument polynomial of I0 in (x / 3.75) ** 2.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
I0_SMALL = (1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813)


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""
    z = x + 8
    series = reduce(lambda acc, c: acc / (z * z) + c, reversed(STIRLING), F.lit(0.0)) / z
    shift = reduce(lambda acc, k: acc * (x + k), range(1, 8), x)
    return (z - 0.5) * F.log(z) - z + LN_2PI / 2 + series - F.log(shift)


def log_i0(x: Column, exact: bool = False) -> Column:
    """ln I0(x) for x >= 0: a polynomial below 3.75, one asymptotic term above (four with exact)."""
    t = (x / 3.75) * (x / 3.75)
    small = F.log(reduce(lambda acc, c: acc * t + c, reversed(I0_SMALL), F.lit(0.0)))
    large = x - 0.5 * F.log(2 * math.pi * x)
    if exact:
        large = large + F.log(1 + 1 / (8 * x) + 9 / (128 * x * x) + 225 / (3072 * x * x * x))
    return F.when(x < 3.75, small).otherwise(large)


def array_logsumexp(xs: Column) -> Column:
    top = F.array_max(xs)
    return F.log(F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))) + top


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def linspace(lo: Column, hi: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / (n - 1))


def uniform(seed: int, *keys: Column | str) -> Column:
    """In (0, 1), a function of the seed and the keys alone: the same under any partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)


def gumbel(seed: int, *keys: Column | str) -> Column:
    return -F.log(-F.log(uniform(seed, *keys)))


def normal(seed: int, *keys: Column | str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *keys, F.lit(1)))) * F.cos(2 * math.pi * uniform(seed, *keys, F.lit(2)))


def linfoot(mi: Column) -> Column:
    return F.sqrt(1 - F.exp(-2 * mi))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is about zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms < 1e-12, 0.0).otherwise(dot(a, b) / norms)
