"""A model's scorers as arrays, for scoring rows where they lie: one pass over Arrow batches, no shuffle of rows.

Scorers are as many as chains x views x clusters x columns, whatever the number of rows; they are collected and go to the
tasks with the function. A batch is turned into columns once and scored a (chain, column) at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import components as K
from weftline.plans.model import Model

FIELDS = ("p0", "p1", "p2", "p3")
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class ViewScorers:
    """Of one column in one view: arrays over cluster ids; `known` is False where there is no such cluster."""

    def __init__(self, rows: list, stat_type: str, width: int):
        self.stat_type = stat_type
        self.known = np.zeros(width, dtype=bool)
        for name in FIELDS:
            setattr(self, name, np.zeros(width))
        self.levels = np.zeros((width, max([len(r["levels"] or ()) for r in rows] + [1])))
        for r in rows:
            k = r["cluster_id"]
            self.known[k] = True
            for name in FIELDS:
                getattr(self, name)[k] = r[name] if r[name] is not None else 0.0
            if r["levels"]:
                self.levels[k, : len(r["levels"])] = r["levels"]
                self.levels[k, len(r["levels"]) :] = r["levels"][-1]

    def code(self, x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(x)
        return (x > 0.5).astype(int) if self.stat_type == K.BINARY else np.clip(x, 0, self.levels.shape[1] - 1).astype(int)

    def logp(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """ln p(x) under clusters z of the same shape."""
        if self.stat_type == K.CONTINUOUS:
            d = x - self.p1[z]
            return self.p3[z] - (self.p0[z] + 1) / 2 * np.log1p(d * d / (self.p0[z] * self.p2[z]))
        if self.stat_type == K.CYCLIC:
            return self.p0[z] * np.cos(x - self.p1[z]) + self.p3[z]
        return self.levels[z, self.code(x)]


def by_view(table: list, model: Model) -> dict[tuple[int, int], ViewScorers]:
    """(chain, col_id) -> scorers, from collected rows of a scorer table."""
    grouped: dict[tuple[int, int], list] = {}
    for r in table:
        grouped.setdefault((r["chain"], r["col_id"]), []).append(r)
    types = {s.col_id: s.stat_type for s in model.columns}
    return {key: ViewScorers(rows, types[key[1]], max(r["cluster_id"] for r in rows) + 1) for key, rows in grouped.items()}


def columns_of(model: Model, rows: DataFrame, *others: str) -> DataFrame:
    """row_id, parts and the model's columns as x0, x1, ... by place."""
    return rows.select("row_id", "parts", *(F.col(f"`{s.name}`").cast("double").alias(f"x{j}") for j, s in enumerate(model.columns)), *others)


def opened(batch: pa.RecordBatch, keys: list[tuple[int, int]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Values of the columns (NaN where missing) and the cluster in each (chain, view) of keys (-1 where there is none)."""
    values = [batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(2, batch.num_columns)]
    parts = batch.column(1)
    z = np.full((len(keys), batch.num_rows), -1)
    flat = parts.flatten()
    if len(flat):
        row = np.repeat(np.arange(batch.num_rows), parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int))
        chain, view, cluster = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        for g, (a, b) in enumerate(keys):
            own = (chain == a) & (view == b)
            z[g, row[own]] = cluster[own]
    return values, z


def anomalies(model: Model, rows: DataFrame, scorers: DataFrame) -> DataFrame:
    """(row_id, anomaly); see queries.anomaly_scores."""
    known = by_view(scorers.select("chain", "cluster_id", "col_id", *FIELDS, "levels").collect(), model)
    keys, chains = sorted({(a, v) for (a, _), v in model.views.items()}), model.chains
    place = {key: g for g, key in enumerate(keys)}
    cols, views = [s.col_id for s in model.columns], model.views

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, z = opened(batch, keys)
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for ch in chains:
                sums, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for x, col in zip(values, cols):
                    if (s := known.get((ch, col))) is None:
                        continue
                    own = z[place[ch, views[ch, col]]]
                    seen = np.flatnonzero(~np.isnan(x) & (own >= 0) & (own < len(s.known)))
                    seen = seen[s.known[own[seen]]]
                    sums[seen] += s.logp(x[seen], own[seen])
                    n[seen] += 1
                has = n > 0
                total[has] += 1 / (1 + np.exp(sums[has] / n[has] + 2))
                count += has
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(count > 0, total / np.maximum(count, 1), 0.5))], ["row_id", "anomaly"])

    id_type = rows.schema["row_id"].dataType.simpleString()
    return columns_of(model, rows).mapInArrow(scored, f"row_id {id_type}, anomaly double")


class LeftOut:
    """Of one column in one view: statistics by cluster id, for a cell's probability under its own cluster without itself."""

    SUMS = ("n", "sx", "sxx", "ssin", "scos")
    HYPERS = ("mu", "r", "s", "nu", "kappa", "vm_a", "vm_mu")

    def __init__(self, rows: list, scorers: ViewScorers):
        width = len(scorers.known)
        self.scorers = scorers
        for name in self.SUMS:
            setattr(self, name, np.zeros(width))
        self.hypers = {h: rows[0][h] for h in self.HYPERS}
        self.levels = np.zeros_like(scorers.levels)
        for r in rows:
            k = r["cluster_id"]
            for name in self.SUMS:
                getattr(self, name)[k] = r[name]
            if r["loo"]:
                self.levels[k, : len(r["loo"])] = r["loo"]
        if scorers.stat_type == K.CONTINUOUS:
            nu = self.hypers["nu"] + np.maximum(self.n - 1, 0)
            self.norm = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in nu])

    def logp(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        h = self.hypers
        if self.scorers.stat_type == K.CONTINUOUS:
            n, sx, sxx = np.maximum(self.n[z] - 1, 0), self.sx[z] - x, np.maximum(self.sxx[z] - x * x, 0)
            r, nu, mean = h["r"] + n, h["nu"] + n, sx / np.maximum(n, 1)
            v = np.where(n > 0, h["nu"] * h["s"] + sxx - sx * mean + h["r"] * n * (h["mu"] - mean) ** 2 / r, h["nu"] * h["s"])
            scale2, d = np.maximum(v, 1e-30) / nu * (1 + 1 / r), x - (h["r"] * h["mu"] + sx) / r
            return self.norm[z] - 0.5 * np.log(nu * math.pi * scale2) - (nu + 1) / 2 * np.log1p(d * d / (nu * scale2))
        if self.scorers.stat_type == K.CYCLIC:
            a = h["kappa"] * (self.scos[z] - np.cos(x)) + h["vm_a"] * math.cos(h["vm_mu"])
            b = h["kappa"] * (self.ssin[z] - np.sin(x)) + h["vm_a"] * math.sin(h["vm_mu"])
            return h["kappa"] * np.cos(x - np.arctan2(b, a)) + self.scorers.p3[z]
        return self.levels[z, self.scorers.code(x)]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        return x ^ (x >> np.uint64(31))


def gumbels(seed: int, row_ids: np.ndarray, chain: int, view: int, n: int) -> np.ndarray:
    """(rows, n) Gumbel numbers, a function of the arguments alone: the same under any partitioning."""
    with np.errstate(over="ignore"):
        base = mixed(np.array([seed, chain, view], dtype=np.int64).view(np.uint64) * GOLDEN + np.arange(1, 4, dtype=np.uint64))
        key = mixed(row_ids.astype(np.int64).view(np.uint64) * GOLDEN + base[0]) ^ base[1]
        h = mixed(mixed(key[:, None] + base[2] + GOLDEN * np.arange(1, n + 1, dtype=np.uint64)[None, :]))
    return -np.log(-np.log(((h >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)))


def drawn_rows(model: Model, seed: int, table: DataFrame, sizes: DataFrame) -> DataFrame:
    """model.rows with new parts: each row's cluster in each view drawn from its leave-one-out conditional over the view's
    clusters, all at once. Rows without an observed cell in a view keep their cluster there. table: see sampler._without_cell."""
    collected = table.select("chain", "cluster_id", "col_id", *FIELDS, "levels", "loo", *LeftOut.SUMS, *LeftOut.HYPERS).collect()
    known = by_view(collected, model)
    grouped: dict[tuple[int, int], list] = {}
    for r in collected:
        grouped.setdefault((r["chain"], r["col_id"]), []).append(r)
    left_out = {key: LeftOut(rows, known[key]) for key, rows in grouped.items()}
    keys = sorted({(a, v) for (a, _), v in model.views.items()})
    counts: dict[tuple[int, int], np.ndarray] = {}
    for r in sizes.collect():
        have = counts.setdefault((r["chain"], r["view_id"]), np.zeros(0))
        if len(have) <= r["cluster_id"]:
            have = counts[r["chain"], r["view_id"]] = np.append(have, np.zeros(r["cluster_id"] + 1 - len(have)))
        have[r["cluster_id"]] = r["n_rows"]
    columns, views, names = [(j, s.col_id) for j, s in enumerate(model.columns)], model.views, model.rows.columns
    at = {n: names.index(n) for n in ("row_id", "parts", *(s.name for s in model.columns))}
    order = [at["row_id"], at["parts"], *(at[s.name] for s in model.columns)]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, z = opened(batch.select(order), keys)
            ids = batch.column(at["row_id"]).to_numpy(zero_copy_only=False)
            for g, (chain, view) in enumerate(keys):
                n = counts.get((chain, view))
                own = z[g]
                mine = [(values[j], known[chain, col], left_out[chain, col]) for j, col in columns if views[chain, col] == view and (chain, col) in known]
                observed = np.zeros(batch.num_rows, dtype=bool)
                for x, _, _ in mine:
                    observed |= ~np.isnan(x)
                rows = np.flatnonzero(observed & (own >= 0))
                if n is None or not len(rows):
                    continue
                own, line = own[rows], np.arange(len(rows))
                left = np.repeat(n[None, :], len(rows), axis=0)
                left[line, own] -= 1
                score = np.where(left > 0, np.log(np.maximum(left, 1)), -1e18) + gumbels(seed, ids[rows], chain, view, len(n))
                score[:, n <= 0] = -np.inf
                for x, scorer, without in mine:
                    x = x[rows]
                    seen = np.flatnonzero(~np.isnan(x))
                    with np.errstate(all="ignore"):  # of clusters that are not there
                        each = scorer.logp(np.repeat(x[seen][:, None], len(n), axis=1), np.repeat(np.arange(len(n))[None, :], len(seen), axis=0))
                    each[np.arange(len(seen)), own[seen]] = without.logp(x[seen], own[seen])
                    score[seen] += np.where(n[None, :] > 0, each, 0)
                z[g, rows] = score.argmax(axis=1)
            yield batch.set_column(at["parts"], "parts", closed(batch.column(at["parts"]), keys, z))

    return model.rows.mapInArrow(moved, model.rows.schema)


def closed(parts: pa.Array, keys: list[tuple[int, int]], z: np.ndarray) -> pa.Array:
    """parts with the clusters of z."""
    lengths = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    row, flat = np.repeat(np.arange(len(parts)), lengths), parts.flatten()
    chain, view, cluster = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int32) for i in range(3))
    for g, (a, b) in enumerate(keys):
        own = (chain == a) & (view == b)
        cluster[own] = z[g, row[own]]
    struct = pa.StructArray.from_arrays([pa.array(chain), pa.array(view), pa.array(cluster)], ["chain", "view_id", "cluster_id"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, struct, mask=parts.is_null() if parts.null_count else None)
