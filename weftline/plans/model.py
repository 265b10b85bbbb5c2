"""A fitted model: rows with their cluster in each view of each chain, and bounded driver-side metadata.

`rows` holds row_id, one DOUBLE column for each modelled column (NULL is missing) and `parts`, an array of
(chain, view_id, cluster_id). Keeping the assignment beside the data makes every per-row query a narrow plan: no join on
row_id. Views, hyper-parameters and concentrations are chains x columns in number and live on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import components as K

PARTS = "array<struct<chain:int,view_id:int,cluster_id:int>>"
HYPERS = "chain int, view_id int, col_id int, name string, stat_type string, n_levels int, mu double, r double, s double, nu double, dir_alpha double, alpha double, beta double, kappa double, vm_a double, vm_mu double, cutpoints array<double>"
HYPER_NAMES = ("mu", "r", "s", "nu", "dir_alpha", "alpha", "beta", "kappa", "vm_a", "vm_mu", "cutpoints")


@dataclass(frozen=True)
class ColumnSpec:
    col_id: int
    name: str
    stat_type: str
    n_levels: int = 0


@dataclass
class Model:
    rows: DataFrame
    columns: list[ColumnSpec]
    views: dict[tuple[int, int], int]  # (chain, col_id) -> view_id
    hypers: dict[tuple[int, int], dict]  # (chain, col_id) -> values by HYPER_NAMES
    alphas: dict[tuple[int, int], float] = field(default_factory=dict)  # (chain, view_id), 1 where absent
    col_alphas: dict[int, float] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    @property
    def chains(self) -> list[int]:
        return sorted({c for c, _ in self.views})

    def with_(self, **changes) -> Model:
        return replace(self, **changes)

    def hyper_table(self) -> DataFrame:
        rows = [(chain, self.views[chain, c.col_id], c.col_id, c.name, c.stat_type, c.n_levels, *(None if (v := self.hypers[chain, c.col_id].get(k)) is None else ([float(x) for x in v] if k == "cutpoints" else float(v)) for k in HYPER_NAMES)) for chain in self.chains for c in self.columns]
        return self.spark.createDataFrame(rows, HYPERS)

    def col_partition(self) -> DataFrame:
        return self.spark.createDataFrame([(chain, col, view) for (chain, col), view in self.views.items()], "chain int, col_id int, view_id int")

    def assigned(self, rows: DataFrame | None = None) -> DataFrame:
        """One row for each row and part."""
        rows = self.rows if rows is None else rows
        return rows.select("*", F.inline("parts")).drop("parts")

    def cells(self, rows: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """(row_id, chain, view_id, cluster_id, col_id, x) for every observed cell, in the views that hold it."""
        return observed(self, self.assigned(rows), keep)


def observed(model: Model, assigned: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    cell = lambda s: F.struct(F.lit(s.col_id).alias("col_id"), F.col(f"`{s.name}`").alias("x"))
    by_view: dict[tuple[int, int], list[ColumnSpec]] = {}
    for spec in model.columns:
        for chain in model.chains:
            by_view.setdefault((chain, model.views[chain, spec.col_id]), []).append(spec)
    # Views that hold the same columns share one branch of the expression.
    groups: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for key, specs in by_view.items():
        groups.setdefault(tuple(s.col_id for s in specs), []).append(key)
    known = {s.col_id: s for s in model.columns}
    cells = None
    for cols, keys in groups.items():
        match = _any([(F.col("chain") == a) & (F.col("view_id") == b) for a, b in keys])
        array = F.array(*(cell(known[i]) for i in cols))
        cells = F.when(match, array) if cells is None else cells.when(match, array)
    return assigned.select("row_id", *keep, "chain", "view_id", "cluster_id", F.inline(cells)).where("x is not null")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out | x
    return out


def default_hypers(rows: DataFrame, specs: list[ColumnSpec]) -> tuple[list[ColumnSpec], dict[int, dict]]:
    """Level counts and hyper-parameters from one aggregate over all rows."""
    aggs = [f(F.col(f"`{s.name}`")).alias(f"{k}{s.col_id}") for s in specs for k, f in (("m", F.avg), ("v", F.var_pop), ("x", F.max))]
    got = rows.agg(*aggs).first()
    columns, hypers = [], {}
    for s in specs:
        mean, var, top = got[f"m{s.col_id}"], got[f"v{s.col_id}"], got[f"x{s.col_id}"]
        levels = {K.BINARY: 2}.get(s.stat_type, (max(1, int(top) + 1) if top is not None else 2) if s.stat_type in (K.CATEGORICAL, K.ORDINAL) else 0)
        levels = max(levels, s.n_levels)
        columns.append(replace(s, n_levels=levels))
        hypers[s.col_id] = {
            K.CONTINUOUS: {"mu": mean if mean is not None else 0.0, "r": 1.0, "s": var + 1e-6 if var is not None else 1.0, "nu": 2.0},
            K.CATEGORICAL: {"dir_alpha": 1.0},
            K.BINARY: {"alpha": 1.0, "beta": 1.0},
            K.ORDINAL: {"mu": 0.0, "s": 4.0, "cutpoints": np.linspace(-2, 2, max(levels - 1, 1)).tolist()},
            K.CYCLIC: {"kappa": 1.0, "vm_a": 1.0, "vm_mu": float(np.pi)},
        }[s.stat_type]
    return columns, hypers


def given(rows: DataFrame, specs: list[ColumnSpec], views: dict[tuple[int, int], int]) -> Model:
    """A model over rows that already carry `parts`, with default hyper-parameters."""
    columns, hypers = default_hypers(rows, specs)
    return Model(rows, columns, views, {key: dict(hypers[key[1]]) for key in views})
