"""Entropies of columns of any type by draws from the fitted joint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.math import array_logsumexp, uniform
from weftline.operators import components as K
from weftline.operators.queries import CLUSTER, cluster_weights
from weftline.operators.sampling import draw, inverted
from weftline.operators.suffstats import scorers
from weftline.plans.model import Model

c = F.col


def conditional_entropy(model: Model, target: int, given: Sequence[int] = (), n: int = 1000, seed: int = 0) -> DataFrame:
    """(target, entropy): the mean of -ln p(target | given) over n draws in each chain, then over chains, in nats; differential
    for continuous and cyclic targets. Given columns outside the target's view tell nothing of it in that chain; with none
    left it is the marginal entropy. Work grows with chains x draws x clusters, not with rows."""
    if target in given:
        raise ValueError("the target must not be among the given columns")
    spark = model.spark
    used = [(ch, model.views[ch, col], col, col == target) for ch in model.chains for col in (target, *given) if model.views[ch, col] == model.views[ch, target]]
    wanted = spark.createDataFrame(used, "chain int, view_id int, col_id int, is_target boolean")
    sc, w = scorers(model), cluster_weights(model)
    views = w.groupBy("chain", "view_id").agg(F.sort_array(F.collect_list(F.struct("cluster_id", "lw"))).alias("w"))  # clusters of a view
    ids = wanted.where("is_target").select("chain", "view_id").join(views, ["chain", "view_id"]).withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    picked = ids.withColumn("cluster_id", F.get(c("w"), inverted(F.transform("w", lambda x: x["lw"]), uniform(seed, "chain", "sample_id", F.lit(3))))["cluster_id"]).drop("w")
    cells = picked.join(wanted, ["chain", "view_id"]).join(sc, [*CLUSTER, "col_id"]).select("chain", "view_id", "sample_id", "col_id", "is_target", draw(seed, "chain", "sample_id", "col_id").alias("value"))
    scored = cells.join(sc, ["chain", "view_id", "col_id"]).withColumn("logp", K.cell_logp(c("value")))
    by_cluster = scored.groupBy(*CLUSTER, "sample_id").agg(F.sum("logp").alias("both"), F.sum(F.when(c("is_target"), 0.0).otherwise(c("logp"))).alias("known")).join(w, CLUSTER)
    each = by_cluster.groupBy("chain", "sample_id").agg((array_logsumexp(F.collect_list(c("lw") + c("known"))) - array_logsumexp(F.collect_list(c("lw") + c("both")))).alias("h"))
    return each.groupBy("chain").agg(F.avg("h").alias("h")).agg(F.avg("h").alias("entropy")).select(F.lit(target).alias("target"), "entropy")
