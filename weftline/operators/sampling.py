"""Monte Carlo queries on counter-based random numbers: a result depends on the seed and the keys, not on partitioning.

Draws stay JVM-side: clusters and levels by inverting cumulative probabilities, Student-t by its polar form, von Mises by
rejection over a fixed run of counters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.math import linfoot, uniform
from weftline.operators import components as K
from weftline.operators.queries import CLUSTER, cluster_weights
from weftline.operators.suffstats import scorers
from weftline.plans.model import Model

c = F.col
TRIES = 32


def student(nu: Column, loc: Column, scale2: Column, seed: int, *keys) -> Column:
    u, v = uniform(seed, *keys, F.lit(11)), uniform(seed, *keys, F.lit(12))
    return loc + F.sqrt(scale2 * nu * (F.pow(u, -2 / nu) - 1)) * F.cos(2 * math.pi * v)


def von_mises(kappa: Column, direction: Column, seed: int, *keys) -> Column:
    """Best and Fisher's rejection; uniform for kappa under 1e-8. The chance that all TRIES fail is under 1e-13."""
    tau = 1 + F.sqrt(1 + 4 * kappa * kappa)
    rho = (tau - F.sqrt(2 * tau)) / (2 * kappa)
    r = (1 + rho * rho) / (2 * rho)

    def attempt(i):
        z = F.cos(math.pi * uniform(seed, *keys, F.lit(21), i))
        f = (1 + r * z) / (r + z)
        w, u = kappa * (r - f), uniform(seed, *keys, F.lit(22), i)
        return F.struct(f.alias("f"), ((w * (2 - w) - u > 0) | (F.log(w / u) + 1 - w >= 0)).alias("ok"))

    kept = F.filter(F.transform(F.sequence(F.lit(1), F.lit(TRIES)), attempt), lambda x: x["ok"])
    f = F.coalesce(F.get(kept, F.lit(0))["f"], F.lit(1.0))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), f))) * F.signum(uniform(seed, *keys, F.lit(23)) - 0.5)
    return F.pmod(F.when(kappa < 1e-8, 2 * math.pi * uniform(seed, *keys, F.lit(24))).otherwise(direction + angle), F.lit(2 * math.pi))


def inverted(logs: Column, u: Column) -> Column:
    """Index drawn from normalised log probabilities."""
    step = lambda acc, x: F.struct((acc["p"] + F.exp(x)).alias("p"), (acc["k"] + F.when(acc["p"] + F.exp(x) < u, 1).otherwise(0)).alias("k"))
    k = F.aggregate(logs, F.struct(F.lit(0.0).alias("p"), F.lit(0).alias("k")), step, lambda acc: acc["k"])
    return F.least(k, F.size(logs) - 1)


def draw(seed: int, *keys) -> Column:
    """A value from a scorer row's predictive."""
    t = c("stat_type")
    return F.when(t == K.CONTINUOUS, student(c("p0"), c("p1"), c("p2"), seed, *keys)).when(t == K.CYCLIC, von_mises(c("p0"), c("p1"), seed, *keys)).otherwise(inverted(c("levels"), uniform(seed, *keys, F.lit(31))).cast("double"))


def per_chain(model: Model, n: int) -> Column:
    """Samples of a chain: an even share, the remainder to the first chains."""
    chains = model.chains
    out = F.lit(0)
    for i, ch in enumerate(chains):
        out = F.when(c("chain") == ch, n // len(chains) + (i < n % len(chains))).otherwise(out)
    return out


def sample(model: Model, col_ids: Sequence[int], n: int, seed: int = 0, conditions: DataFrame | None = None, joint: bool = False) -> DataFrame:
    """(query_id, chain, sample_id, col_id, name, value): each column draws its own cluster; with joint, a view's columns share
    one. Without conditions there is one query, 0."""
    w = cluster_weights(model, conditions) if conditions is not None else cluster_weights(model).withColumn("query_id", F.lit(0))
    sc = scorers(model).where(c("col_id").isin(*col_ids))
    views = w.groupBy("query_id", "chain", "view_id").agg(F.sort_array(F.collect_list(F.struct("cluster_id", "lw"))).alias("w"))  # clusters of a view
    cols = sc.select("chain", "view_id", "col_id", "name").distinct()
    ids = views.join(cols, ["chain", "view_id"]).withColumn("sample_id", F.explode(F.sequence(F.lit(0), per_chain(model, n) - 1))).where(c("sample_id") >= 0)
    u = uniform(seed, "query_id", "chain", "view_id", "sample_id", *([] if joint else ["col_id"]), F.lit(1))
    picked = ids.withColumn("cluster_id", F.get(c("w"), inverted(F.transform("w", lambda x: x["lw"]), u))["cluster_id"]).drop("w", "name")
    return picked.join(sc, [*CLUSTER, "col_id"]).withColumn("value", draw(seed, "query_id", "chain", "sample_id", "col_id")).select("query_id", "chain", "sample_id", "col_id", "name", "value")


def sample_rows(model: Model, col_ids: Sequence[int], n: int, seed: int = 0, rows: DataFrame | None = None) -> DataFrame:
    """(row_id, chain, sample_id, col_id, name, stat_type, value) under each row's own clusters."""
    sc = scorers(model).where(c("col_id").isin(*col_ids))
    own = model.assigned(rows).select("row_id", *CLUSTER).join(sc, CLUSTER)
    each = own.withColumn("sample_id", F.explode(F.sequence(F.lit(0), per_chain(model, n) - 1))).where(c("sample_id") >= 0)
    return each.withColumn("value", draw(seed, "row_id", "chain", "sample_id", "col_id")).select("row_id", "chain", "sample_id", "col_id", "name", "stat_type", "value")


def credible_interval(samples: DataFrame, keys: Sequence[str], level: float = 0.9) -> DataFrame:
    if not 0 < level < 1:
        raise ValueError("the level must lie between 0 and 1")
    q = F.percentile("value", F.array(F.lit(0.5), F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return samples.groupBy(*keys).agg(q.alias("q")).select(*keys, c("q")[0].alias("median"), c("q")[1].alias("lo"), c("q")[2].alias("hi"))


def impute(model: Model, col_id: int, n: int = 100, seed: int = 0, rows: DataFrame | None = None) -> DataFrame:
    """(row_id, value, confidence): continuous median and 1 / (1 + sd); others the mode (ties to the smaller code) and its
    share; cyclic the mean direction and the resultant length."""
    s = sample_rows(model, [col_id], n, seed, rows)
    kind = next(x.stat_type for x in model.columns if x.col_id == col_id)
    if kind == K.CONTINUOUS:
        return s.groupBy("row_id").agg(F.median("value").alias("value"), (1 / (1 + F.stddev_pop("value"))).alias("confidence"))
    if kind == K.CYCLIC:
        x, y = F.avg(F.cos("value")), F.avg(F.sin("value"))
        return s.groupBy("row_id").agg(F.pmod(F.atan2(y, x), F.lit(2 * math.pi)).alias("value"), F.sqrt(x * x + y * y).alias("confidence"))
    counts = s.groupBy("row_id", "value").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("row_id").agg(F.max_by("value", F.struct(c("k"), -c("value"))).alias("value"), (F.max("k") / F.sum("k")).alias("confidence"))


def cdf(samples: DataFrame, keys: Sequence[str], at: float) -> DataFrame:
    return samples.groupBy(*keys).agg(F.avg((c("value") <= at).cast("double")).alias("cdf"))


def mutual_information(model: Model, pairs: Sequence[tuple[int, int]], n: int = 1000, seed: int = 0) -> DataFrame:
    """(col_i, col_j, mi, linfoot) by draws from each view's joint: mean of ln p(x, y) - ln p(x) - ln p(y), at least 0; 0 in
    chains that keep the columns apart; mean over chains."""
    rows = [(ch, model.views[ch, i], i, j) for ch in model.chains for i, j in pairs if model.views[ch, i] == model.views[ch, j]]
    spark = model.spark
    wanted = spark.createDataFrame(rows, "chain int, view_id int, col_i int, col_j int")
    sc, w = scorers(model), cluster_weights(model)
    ws = w.groupBy("chain", "view_id").agg(F.sort_array(F.collect_list(F.struct("cluster_id", "lw"))).alias("w"))
    ids = wanted.join(ws, ["chain", "view_id"]).withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ids = ids.withColumn("cluster_id", F.get(c("w"), inverted(F.transform("w", lambda x: x["lw"]), uniform(seed, "chain", "col_i", "col_j", "sample_id")))["cluster_id"]).drop("w")

    def drawn(df: DataFrame, col: str, out: str, salt: int) -> DataFrame:
        s = sc.withColumnRenamed("col_id", col)
        return df.join(s, [*CLUSTER, col]).withColumn(out, draw(seed + salt, "chain", "col_i", "col_j", "sample_id")).select("chain", "view_id", "cluster_id", "col_i", "col_j", "sample_id", *(["x"] if out == "y" else []), out)

    xy = drawn(drawn(ids, "col_i", "x", 1), "col_j", "y", 2).drop("cluster_id")
    scored = lambda df, col, x, out: df.join(sc.withColumnRenamed("col_id", col), [*(["chain", "view_id"] if "cluster_id" not in df.columns else CLUSTER), col]).withColumn(out, K.cell_logp(c(x))).select("chain", "view_id", "cluster_id", "col_i", "col_j", "sample_id", "x", "y", *(["lx"] if out == "ly" else []), out)
    both = scored(scored(xy, "col_i", "x", "lx"), "col_j", "y", "ly").join(w, CLUSTER)
    key = ["chain", "col_i", "col_j", "sample_id"]
    each = both.groupBy(*key).agg((F.log(F.sum(F.exp(c("lw") + c("lx") + c("ly")))) - F.log(F.sum(F.exp(c("lw") + c("lx")))) - F.log(F.sum(F.exp(c("lw") + c("ly"))))).alias("v"))
    mi = each.groupBy("chain", "col_i", "col_j").agg(F.greatest(F.lit(0.0), F.avg("v")).alias("mi"))
    every = spark.createDataFrame([(ch, i, j) for ch in model.chains for i, j in pairs], "chain int, col_i int, col_j int")
    return every.join(mi, ["chain", "col_i", "col_j"], "left").groupBy("col_i", "col_j").agg(F.avg(F.coalesce("mi", F.lit(0.0))).alias("mi")).withColumn("linfoot", linfoot(c("mi")))


def holdout_mask(rows: DataFrame, names: Sequence[str], fraction: float, seed: int = 0) -> DataFrame:
    """(row_id, name) of cells held out."""
    return rows.select("row_id", F.explode(F.array(*map(F.lit, names))).alias("name")).where(uniform(seed, "row_id", "name") < fraction)


def evaluate_imputation(model: Model, held_out: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """(name, metric, score, n) from held-out cells (row_id, name, value): mean absolute error (circular for cyclic), or
    accuracy. The model should have been fitted without those cells."""
    out = None
    for s in model.columns:
        cells = held_out.where((c("name") == s.name) & c("value").isNotNull()).select("row_id", "value")
        rows = model.rows.join(cells.select("row_id").distinct(), "row_id", "left_semi")
        both = impute(model, s.col_id, n, seed, rows).select("row_id", c("value").alias("guess")).join(cells, "row_id")
        e = F.abs(c("guess") - c("value"))
        score = {K.CONTINUOUS: e, K.CYCLIC: F.least(e, 2 * math.pi - e)}.get(s.stat_type, (c("guess") == c("value")).cast("double"))
        one = both.agg(F.lit(s.name).alias("name"), F.lit("mae" if s.stat_type in (K.CONTINUOUS, K.CYCLIC) else "accuracy").alias("metric"), F.avg(score).alias("score"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
