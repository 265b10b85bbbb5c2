"""The five collapsed column models over additive sufficient statistics.

A statistics row has n, sx, sxx, counts (by level), ssin, scos. A scorer row is what a cell needs: a few numbers, or a log
probability for each level; it is built on the small statistics table, so scoring a cell is plain arithmetic or one array
look-up. All functions take and return Column expressions named as in the statistics and hyper-parameter tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.math import LN_2PI, LOG_EPS, array_logsumexp, lgamma, linspace, log_i0, logistic

CONTINUOUS, CATEGORICAL, ORDINAL, BINARY, CYCLIC = "CONTINUOUS", "CATEGORICAL", "ORDINAL", "BINARY", "CYCLIC"
TYPES = (CONTINUOUS, CATEGORICAL, ORDINAL, BINARY, CYCLIC)
ORDINAL_GRID = 31

c = F.col


def by_type(continuous: Column, categorical: Column, ordinal: Column, binary: Column, cyclic: Column) -> Column:
    t = c("stat_type")
    return F.when(t == CONTINUOUS, continuous).when(t == CATEGORICAL, categorical).when(t == ORDINAL, ordinal).when(t == BINARY, binary).when(t == CYCLIC, cyclic)


def nig_posterior() -> dict[str, Column]:
    n, r = c("n"), c("r") + c("n")
    mean = c("sx") / F.greatest(n, F.lit(1))
    v = F.when(n > 0, c("nu") * c("s") + c("sxx") - c("sx") * mean + c("r") * n * (c("mu") - mean) * (c("mu") - mean) / r).otherwise(c("nu") * c("s"))
    return {"r": r, "nu": c("nu") + n, "mu": (c("r") * c("mu") + c("sx")) / r, "v": F.greatest(v, F.lit(LOG_EPS))}


def sum_of(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def ordinal_points() -> tuple[Column, Column]:
    """The latent grid, and at each point the log of likelihood times prior."""
    grid = linspace(c("mu") - 4 * F.sqrt(c("s")), c("mu") + 4 * F.sqrt(c("s")), ORDINAL_GRID)
    prior = lambda m: -0.5 * (LN_2PI + F.log(c("s")) + (m - c("mu")) * (m - c("mu")) / c("s"))
    return grid, F.transform(grid, lambda m: sum_of(F.transform(c("counts"), lambda k, i: k * F.log(level_probability(m, i)))) + prior(m))


def level_probability(m: Column, level: Column) -> Column:
    upper = F.when(level >= F.size("cutpoints"), 1.0).otherwise(logistic(F.get(c("cutpoints"), level) - m))
    lower = F.when(level <= 0, 0.0).otherwise(logistic(F.get(c("cutpoints"), level - 1) - m))
    return F.greatest(upper - lower, F.lit(LOG_EPS))


def log_marginal() -> Column:
    """ln p(the cluster's data in this column | hyper-parameters)."""
    n, p = c("n"), nig_posterior()
    continuous = -n / 2 * LN_2PI + 0.5 * F.log(c("r") / p["r"]) + c("nu") / 2 * F.log(c("nu") * c("s") / 2) - p["nu"] / 2 * F.log(p["v"] / 2) + lgamma(p["nu"] / 2) - lgamma(c("nu") / 2)
    k, a = c("n_levels"), c("dir_alpha")
    categorical = sum_of(F.transform("counts", lambda x: lgamma(x + a) - lgamma(a))) - lgamma(n + k * a) + lgamma(k * a)
    step = 8 * F.sqrt(c("s")) / (ORDINAL_GRID - 1)
    ordinal = F.when(n > 0, array_logsumexp(ordinal_points()[1]) + F.log(step)).otherwise(0.0)
    binary = lgamma(c("alpha") + c("beta")) - lgamma(c("alpha")) - lgamma(c("beta")) + lgamma(c("sx") + c("alpha")) + lgamma(n - c("sx") + c("beta")) - lgamma(n + c("alpha") + c("beta"))
    cyclic = -n * LN_2PI + log_i0(resultant()[0]) - n * log_i0(c("kappa")) - log_i0(c("vm_a"))
    return F.when(n == 0, 0.0).otherwise(by_type(continuous, categorical, ordinal, binary, cyclic))


def resultant() -> tuple[Column, Column]:
    """Length and direction of the posterior of a cyclic column."""
    x = c("kappa") * c("scos") + c("vm_a") * F.cos("vm_mu")
    y = c("kappa") * c("ssin") + c("vm_a") * F.sin("vm_mu")
    return F.sqrt(x * x + y * y), F.atan2(y, x)


def scorer(stats: DataFrame) -> DataFrame:
    """Adds p0..p3 and levels to a statistics table joined with its hyper-parameters; see cell_logp."""
    p = nig_posterior()
    scale2 = F.greatest(p["v"] / p["nu"] * (1 + 1 / p["r"]), F.lit(LOG_EPS))
    norm = lgamma((p["nu"] + 1) / 2) - lgamma(p["nu"] / 2) - 0.5 * F.log(p["nu"] * math.pi * scale2)
    k, a = c("n_levels"), c("dir_alpha")
    categorical = F.transform("counts", lambda x: F.log(F.greatest((x + a) / (c("n") + k * a), F.lit(LOG_EPS))))
    p1 = (c("sx") + c("alpha")) / (c("n") + c("alpha") + c("beta"))
    binary = F.array(F.log(F.greatest(1 - p1, F.lit(LOG_EPS))), F.log(F.greatest(p1, F.lit(LOG_EPS))))
    grid, points = ordinal_points()
    with_points = stats.withColumn("grid", F.when(c("stat_type") == ORDINAL, grid)).withColumn("points", F.when(c("stat_type") == ORDINAL, points)).withColumn("total", array_logsumexp(c("points")))
    each = F.zip_with("grid", "points", lambda m, w: F.struct(m.alias("m"), F.exp(w - c("total")).alias("w")))
    ordinal = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.log(F.greatest(F.aggregate(c("each"), F.lit(0.0), lambda acc, x: acc + x["w"] * level_probability(x["m"], i)), F.lit(LOG_EPS))))
    none = F.lit(None).cast("double")
    return with_points.withColumn("each", each).select(
        *stats.columns,
        by_type(p["nu"], none, none, none, c("kappa")).alias("p0"), by_type(p["mu"], none, none, none, resultant()[1]).alias("p1"),
        by_type(scale2, none, none, none, none).alias("p2"), by_type(norm, none, none, none, -LN_2PI - log_i0(c("kappa"))).alias("p3"),
        F.when(c("stat_type") == CATEGORICAL, categorical).when(c("stat_type") == ORDINAL, ordinal).when(c("stat_type") == BINARY, binary).alias("levels"),
    )


def cell_logp(x: Column) -> Column:
    """ln p(x | cluster) from a scorer row; a code outside the levels counts as the nearest."""
    t = c("stat_type")
    student = c("p3") - (c("p0") + 1) / 2 * F.log1p((x - c("p1")) * (x - c("p1")) / (c("p0") * c("p2")))
    code = F.when(t == BINARY, F.when(x > 0.5, 1).otherwise(0)).otherwise(F.least(F.greatest(x.cast("int"), F.lit(0)), F.size("levels") - 1))
    return F.when(t == CONTINUOUS, student).when(t == CYCLIC, c("p0") * F.cos(x - c("p1")) + c("p3")).otherwise(F.get(c("levels"), code))
