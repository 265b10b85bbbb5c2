"""Synthetic tables with a known structure: columns dealt to views in turn, equal clusters, types' own draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.math import normal, uniform
from weftline.operators import components as K
from weftline.plans.model import ColumnSpec


def generate(spark: SparkSession, n_rows: int, types: Sequence[str], n_views: int = 2, n_clusters: int = 2, separation: float = 5.0, seed: int = 0) -> tuple[DataFrame, list[ColumnSpec]]:
    """row_id, a column c0, c1, … for each type, and truth_v0, …: the cluster in each view."""
    df = spark.range(n_rows).withColumnRenamed("id", "row_id")
    for v in range(n_views):
        df = df.withColumn(f"truth_v{v}", F.pmod(F.xxhash64(F.lit(seed), F.lit(v), "row_id"), F.lit(n_clusters)).cast("int"))
    specs = []
    for j, kind in enumerate(types):
        k, u = F.col(f"truth_v{j % n_views}"), uniform(seed, F.lit(j), "row_id")
        levels = max(3, n_clusters + 1)
        df = df.withColumn(f"c{j}", _value(kind, k, u, seed, j, levels, n_clusters, separation))
        specs.append(ColumnSpec(j, f"c{j}", kind, levels if kind in (K.CATEGORICAL, K.ORDINAL) else 2 if kind == K.BINARY else 0))
    return df, specs


def _value(kind: str, k: Column, u: Column, seed: int, j: int, levels: int, clusters: int, separation: float) -> Column:
    noise = normal(seed + 1, F.lit(j), "row_id")
    if kind == K.CONTINUOUS:
        return k * separation + noise
    if kind == K.BINARY:
        return (u < 0.2 + 0.6 * k / max(1, clusters - 1)).cast("double")
    if kind == K.CYCLIC:
        return F.pmod(k * 2 * math.pi / clusters + 0.5 * noise, F.lit(2 * math.pi))
    # A dominant level of weight 5 against .1 for each other.
    share = 5.0 / (5.0 + 0.1 * (levels - 1))
    other = F.pmod(k + 1 + F.floor((u - share) / (1 - share) * (levels - 1)), F.lit(levels))
    return F.when(u < share, k).otherwise(other).cast("double")


def add_missing(df: DataFrame, names: Sequence[str], fraction: float = 0.1, seed: int = 0) -> DataFrame:
    return df.withColumns({n: F.when(uniform(seed, F.lit(n), "row_id") >= fraction, F.col(n)) for n in names})
