"""Checks on a model: dependence constraints and consistency. A result without rows is a valid model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import components as K
from weftline.plans.model import Model

c = F.col


def check_column_constraints(model: Model, constraints: Sequence[tuple[int, int, bool]]) -> DataFrame:
    """(chain, col_a, col_b, dependent, satisfied) for pairs that must share a view, or must not."""
    rows = [(ch, a, b, dep, (model.views[ch, a] == model.views[ch, b]) == dep) for ch in model.chains for a, b, dep in constraints]
    return model.spark.createDataFrame(rows, "chain int, col_a int, col_b int, dependent boolean, satisfied boolean")


def check_row_constraints(model: Model, constraints: DataFrame, view_id: int | None = None) -> DataFrame:
    """constraints: (row_a, row_b, dependent); satisfied in a chain when it holds in every view (or the one given)."""
    parts = model.assigned(model.rows.join(constraints.select(F.explode(F.array("row_a", "row_b")).alias("row_id")).distinct(), "row_id", "left_semi"))
    parts = parts if view_id is None else parts.where(c("view_id") == view_id)
    a, b = (parts.select(c("row_id").alias(f"row_{x}"), "chain", "view_id", c("cluster_id").alias(f"c{x}")) for x in "ab")
    both = constraints.join(a, "row_a").join(b, ["row_b", "chain", "view_id"])
    return both.groupBy("row_a", "row_b", "dependent", "chain").agg(F.bool_and((c("ca") == c("cb")) == c("dependent")).alias("satisfied"))


def validate(model: Model) -> DataFrame:
    """(problem, chain, view_id, count): rows without a part in some view, parts of unknown views, repeated parts, negative
    clusters, repeated row ids, codes out of range, bad concentrations."""
    spark = model.spark
    want = sorted({(ch, v) for (ch, _), v in model.views.items()})
    known = F.array(*(F.struct(F.lit(a).alias("chain"), F.lit(b).alias("view_id")) for a, b in want))
    own = F.transform("parts", lambda p: F.struct(p["chain"].alias("chain"), p["view_id"].alias("view_id")))
    bad = {"missing part": F.size(F.array_except(known, own)), "unknown view": F.size(F.array_except(own, known)), "repeated part": F.size(own) - F.size(F.array_distinct(own)), "negative cluster": F.size(F.filter("parts", lambda p: p["cluster_id"] < 0))}
    for s in model.columns:
        if s.stat_type in (K.CATEGORICAL, K.ORDINAL, K.BINARY):
            x = c(f"`{s.name}`")
            bad[f"code of {s.name}"] = F.when(x.isNotNull() & ((x < 0) | (x >= max(1, s.n_levels))), 1).otherwise(0)
    sums = model.rows.agg(*(F.sum(v.cast("long")).alias(f"b{i}") for i, v in enumerate(bad.values())), (F.count("row_id") - F.countDistinct("row_id")).alias("repeats"))
    found = sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("problem"), c(f"b{i}").alias("count")) for i, k in enumerate(bad)), F.struct(F.lit("repeated row_id").alias("problem"), c("repeats").alias("count")))))
    alphas = [("concentration", 1) for a in [*model.alphas.values(), *model.col_alphas.values()] if not a > 0]
    absent = [("column without a view", 1) for ch in model.chains for s in model.columns if (ch, s.col_id) not in model.views]
    more = spark.createDataFrame([*alphas, *absent], "problem string, count long")
    return found.where("count > 0").unionByName(more)


def assert_valid(model: Model) -> None:
    problems = validate(model).limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{r.problem}: {r['count']}" for r in problems))
