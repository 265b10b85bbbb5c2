"""Sufficient statistics of every (chain, view, cluster, column): one pass, partial aggregates, one small shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import components as K
from weftline.plans.model import Model

KEY = ("chain", "view_id", "cluster_id", "col_id")
SUMS = ("n", "sx", "sxx", "ssin", "scos")


def sizes(model: Model, rows: DataFrame | None = None) -> DataFrame:
    """(chain, view_id, cluster_id, n_rows): all rows, missing cells or not."""
    return model.assigned(rows).groupBy("chain", "view_id", "cluster_id").agg(F.count(F.lit(1)).alias("n_rows"))


def leveled(cells: DataFrame, model: Model) -> DataFrame:
    """Statistics by level; levels are NULL but for categorical and ordinal columns."""
    coded = [c.col_id for c in model.columns if c.stat_type in (K.CATEGORICAL, K.ORDINAL)]
    binary = [c.col_id for c in model.columns if c.stat_type == K.BINARY]
    x = F.when(F.col("col_id").isin(binary), (F.col("x") > 0.5).cast("double")).otherwise(F.col("x"))
    level = F.when(F.col("col_id").isin(coded), F.col("x").cast("int"))
    return cells.select(*KEY, x.alias("x"), level.alias("level")).groupBy(*KEY, "level").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.sin("x")).alias("ssin"), F.sum(F.cos("x")).alias("scos"))


def suffstats(model: Model, rows: DataFrame | None = None) -> DataFrame:
    """Statistics with hyper-parameters for every cluster that has rows; n = 0 where a column has no observed cell there."""
    by_level = leveled(model.cells(rows), model)
    full = sizes(model, rows).join(model.hyper_table(), ["chain", "view_id"])
    level = F.when(F.col("level").isNotNull(), F.struct(F.col("level"), F.col("n").alias("k")))
    stats = by_level.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in SUMS), F.map_from_entries(F.collect_list(level)).alias("m"))
    both = full.join(stats, [*KEY], "left")
    zeros = {"n": F.lit(0).cast("long"), **{c: F.lit(0.0) for c in SUMS[1:]}}
    both = both.select(*(c for c in full.columns), *(F.coalesce(c, z).alias(c) for c, z in zeros.items()), "m")
    dense = F.transform(F.sequence(F.lit(0), F.col("n_levels") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    counts = F.when(F.col("stat_type").isin(K.CATEGORICAL, K.ORDINAL), dense).otherwise(F.array().cast("array<bigint>"))
    return both.withColumn("counts", counts).drop("m")


def add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Statistics are additive: a + b, or a - b with sign -1. Both by level (see leveled)."""
    other = b.select(*KEY, "level", *((F.col(c) * sign).alias(c) for c in SUMS))
    return a.select(*KEY, "level", *SUMS).unionByName(other).groupBy(*KEY, "level").agg(*(F.sum(c).alias(c) for c in SUMS))


def scorers(model: Model, rows: DataFrame | None = None) -> DataFrame:
    return K.scorer(suffstats(model, rows))
