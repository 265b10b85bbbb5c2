"""Fitting by Gibbs kernels. The synchronous row kernel is the distributed one; the exact one runs a view in one task.

A sweep is rows, columns, hyper-parameters, concentrations. Rows are rewritten once in each sweep and cut from their
lineage in the shared checkpoint folder; all else is chains x columns x clusters in size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.math import gumbel, uniform
from weftline.operators import arrays
from weftline.operators import components as K
from weftline.operators.constraints import check_row_constraints
from weftline.operators.ingest import suggest_max_clusters
from weftline.operators.queries import CLUSTER, log_joint
from weftline.operators.suffstats import sizes, suffstats
from weftline.plans.model import PARTS, ColumnSpec, Model, default_hypers
from weftline.plans.store import settle

c = F.col
GRID = 31
KERNELS = ("rows", "columns", "hypers", "alphas")


def crp(rng: np.random.Generator, alpha: float, n: int) -> list[int]:
    counts: list[int] = []
    out = []
    for _ in range(n):
        k = int(rng.choice(len(counts) + 1, p=np.array([*counts, alpha]) / (sum(counts) + alpha)))
        if k == len(counts):
            counts.append(0)
        counts[k] += 1
        out.append(k)
    return out


def stick_cluster(seed: int, alpha: float, most: int, *keys) -> Column:
    """A cluster from stick-breaking weights, the law of the CRP without its sequence; the last of `most` takes the rest."""
    rng = np.random.default_rng(seed)
    left, edges = 1.0, []
    for _ in range(most - 1):
        b = rng.beta(1, alpha)
        edges.append(1 - left * (1 - b))
        left *= 1 - b
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < uniform(seed, *keys)))


def initialize(rows: DataFrame, specs: Sequence[ColumnSpec], n_chains: int = 1, seed: int = 0, mode: str = "from_the_prior", alpha: float = 1.0, max_clusters: int | None = None) -> Model:
    """rows: row_id and the columns. Modes: from_the_prior, together, apart. Hyper-parameters come from all rows."""
    if mode not in ("from_the_prior", "together", "apart") or n_chains < 1 or not specs:
        raise ValueError("unknown mode, no chains or no columns")
    columns, hypers = default_hypers(rows, list(specs))
    most = max_clusters or suggest_max_clusters(rows.count())
    rng = np.random.default_rng(seed)
    views: dict[tuple[int, int], int] = {}
    parts = []
    for ch in range(n_chains):
        of = crp(rng, alpha, len(columns)) if mode == "from_the_prior" else [0] * len(columns) if mode == "together" else list(range(len(columns)))
        views |= {(ch, s.col_id): v for s, v in zip(columns, of)}
        for v in sorted({*of}):
            cluster = F.lit(0) if mode == "together" else F.pmod(F.xxhash64(F.lit(seed + v), "row_id"), F.lit(most)) if mode == "apart" else stick_cluster(seed * 1009 + ch * 101 + v, alpha, most, "row_id", F.lit(ch), F.lit(v))
            parts.append(F.struct(F.lit(ch).alias("chain"), F.lit(v).alias("view_id"), cluster.cast("int").alias("cluster_id")))
    model = Model(rows.withColumn("parts", F.array(*parts).cast(PARTS)), columns, views, {key: dict(hypers[key[1]]) for key in views})
    return model.with_(rows=settle(model.rows))


# --- rows ----------------------------------------------------------------------------------------------------------


def _without_cell(stats: DataFrame) -> DataFrame:
    """Scorers, and for discrete columns the log probability of each level after one cell of that level is taken out."""
    sc = K.scorer(stats)
    less = stats.where(c("stat_type").isin(K.CATEGORICAL, K.ORDINAL, K.BINARY)).withColumn("gone", F.explode(F.sequence(F.lit(0), c("n_levels") - 1)))
    one = less.withColumn("counts", F.transform("counts", lambda k, i: F.greatest(k - (i == c("gone")).cast("long"), F.lit(0).cast("long")))).withColumn("sx", F.greatest(c("sx") - c("gone"), F.lit(0.0))).withColumn("n", F.greatest(c("n") - 1, F.lit(0).cast("long")))
    loo = K.scorer(one).groupBy(*CLUSTER, "col_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("gone", F.get(c("levels"), c("gone")).alias("lp")))), lambda x: x["lp"]).alias("loo"))
    return sc.join(loo, [*CLUSTER, "col_id"], "left")


def row_kernel(model: Model, seed: int) -> Model:
    """Every row drawn at once from its leave-one-out conditional over the existing clusters (no births; approximate).
    Scoring, noise and the choice are one pass over the rows where they lie."""
    return model.with_(rows=settle(arrays.drawn_rows(model, seed, _without_cell(suffstats(model)), sizes(model))))


def _moved(model: Model, drawn: DataFrame) -> Model:
    """The model with the clusters of drawn (row_id, chain, view_id, cluster_id) instead of the rows' own."""
    new = drawn.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("chain", "view_id"), "cluster_id"))).alias("new"))
    part = lambda p: F.struct(p["chain"].alias("chain"), p["view_id"].alias("view_id"), F.coalesce(F.try_element_at("new", F.struct(p["chain"].alias("chain"), p["view_id"].alias("view_id"))), p["cluster_id"]).alias("cluster_id"))
    rows = model.rows.join(new, "row_id", "left").withColumn("parts", F.when(c("new").isNull(), c("parts")).otherwise(F.transform("parts", part)).cast(PARTS)).drop("new")
    return model.with_(rows=settle(rows.select(*model.rows.columns)))


class ExactView:
    """Sequential collapsed Gibbs over the rows of one view, in numpy. With known (n, s), the sizes and statistics of all rows'
    clusters, x and z (places in n) may be some of the rows."""

    def __init__(self, x: np.ndarray, z: np.ndarray, specs: list[ColumnSpec], hypers: list[dict], alpha: float, known: tuple[np.ndarray, list[np.ndarray]] | None = None):
        self.x, self.specs, self.hypers, self.alpha = x, specs, hypers, alpha
        if known:
            self.z, self.n, self.s = z.copy(), known[0].copy(), [s.copy() for s in known[1]]
        else:
            self.z = np.unique(z, return_inverse=True)[1]
            self.n = np.bincount(self.z).astype(float)
            self.s = [np.stack([self.stat(j, x[self.z == k, j]).sum(axis=0) for k in range(len(self.n))]) for j in range(len(specs))]
        self.edges = {j: np.concatenate([[-1e10], h["cutpoints"], [1e10]])[: s.n_levels + 1] for j, (s, h) in enumerate(zip(specs, hypers)) if s.stat_type == K.ORDINAL}

    def stat(self, j: int, v: np.ndarray) -> np.ndarray:
        """Additive statistics of values, zeros where missing."""
        s, seen = self.specs[j], ~np.isnan(v)
        w = np.where(seen, v, 0.0)
        if s.stat_type == K.CONTINUOUS:
            out = np.stack([seen, w, w * w], axis=1)
        elif s.stat_type == K.CYCLIC:
            out = np.stack([seen, np.where(seen, np.sin(w), 0), np.where(seen, np.cos(w), 0)], axis=1)
        else:
            levels = max(2, s.n_levels) if s.stat_type == K.BINARY else s.n_levels
            code = np.clip(w > 0.5 if s.stat_type == K.BINARY else w, 0, levels - 1).astype(int)
            out = np.eye(levels)[code] * seen[:, None]
        return out.astype(float)

    def logp(self, j: int, v: float, s: np.ndarray) -> np.ndarray:
        """ln p(v) under each row of statistics s."""
        kind, h = self.specs[j].stat_type, self.hypers[j]
        if kind == K.CONTINUOUS:
            n, sx, sxx = s.T
            r, nu, mean = h["r"] + n, h["nu"] + n, sx / np.maximum(n, 1)
            var = np.maximum(h["nu"] * h["s"] + sxx - sx * mean + h["r"] * n * (h["mu"] - mean) ** 2 / r, 1e-30)
            scale2, d = var / nu * (1 + 1 / r), v - (h["r"] * h["mu"] + sx) / r
            lg = np.vectorize(math.lgamma)
            return lg((nu + 1) / 2) - lg(nu / 2) - 0.5 * np.log(nu * np.pi * scale2) - (nu + 1) / 2 * np.log1p(d * d / (nu * scale2))
        if kind == K.CYCLIC:
            a = h["kappa"] * s[:, 2] + h["vm_a"] * math.cos(h["vm_mu"])
            b = h["kappa"] * s[:, 1] + h["vm_a"] * math.sin(h["vm_mu"])
            return h["kappa"] * np.cos(v - np.arctan2(b, a)) - math.log(2 * math.pi) - math.log(np.i0(h["kappa"]))
        code = int(v > 0.5) if kind == K.BINARY else int(np.clip(v, 0, s.shape[1] - 1))
        if kind == K.ORDINAL:
            grid = h["mu"] + np.linspace(-4, 4, K.ORDINAL_GRID) * math.sqrt(h["s"])
            p = np.maximum(np.diff(1 / (1 + np.exp(-np.clip(self.edges[j][None, :] - grid[:, None], -700, 700))), axis=1), 1e-30)
            w = s @ np.log(p).T - (grid - h["mu"]) ** 2 / (2 * h["s"])
            w = np.exp(w - w.max(axis=1, keepdims=True))
            return np.log(np.maximum(w @ p[:, code] / w.sum(axis=1), 1e-30))
        prior = np.array([h["beta"], h["alpha"]]) if kind == K.BINARY else np.full(s.shape[1], h["dir_alpha"])
        return np.log((s[:, code] + prior[code]) / (s.sum(axis=1) + prior.sum()))

    def move(self, i: int, rng: np.random.Generator) -> None:
        cells = [(j, self.stat(j, self.x[i : i + 1, j])[0]) for j in range(len(self.specs)) if not np.isnan(self.x[i, j])]
        k = self.z[i]
        self.n[k] -= 1
        for j, own in cells:
            self.s[j][k] -= own
        score = np.log(np.append(np.where(self.n > 0, self.n, 1e-300), self.alpha))
        for j, own in cells:
            score += self.logp(j, self.x[i, j], np.vstack([self.s[j], np.zeros_like(own)]))
        score[:-1][self.n <= 0] = -np.inf
        k = int(np.argmax(score + rng.gumbel(size=len(score))))
        if k == len(self.n):
            free = np.flatnonzero(self.n <= 0)
            if len(free):
                k = int(free[0])
            else:
                self.n = np.append(self.n, 0.0)
                self.s = [np.vstack([s, np.zeros(s.shape[1])]) for s in self.s]
        self.z[i] = k
        self.n[k] += 1
        for j, own in cells:
            self.s[j][k] += own


def row_kernel_exact(model: Model, seed: int, batch_size: int | None = None, most_rows: int = 200_000) -> Model:
    """The sequential kernel, one task for each chain and view; with batch_size only that many rows move, see row_kernel_batch.
    Else a view's rows must fit a task, so more than most_rows is an error: use row_kernel there."""
    if batch_size:
        return row_kernel_batch(model, seed, batch_size)
    total = model.rows.count()
    if total > most_rows:
        raise ValueError(f"{total} rows: the exact kernel takes at most {most_rows}")
    specs, hypers, alphas, views = model.columns, model.hypers, model.alphas, model.views

    def run(key, pdf):
        chain, view = (int(x) for x in key)
        own = [s for s in specs if views[chain, s.col_id] == view]
        pdf = pdf.sort_values("row_id", ignore_index=True)
        state = ExactView(pdf[[s.name for s in own]].to_numpy(dtype=float), pdf["cluster_id"].to_numpy(), own, [hypers[chain, s.col_id] for s in own], alphas.get((chain, view), 1.0))
        rng = np.random.default_rng([seed, chain, view])
        for i in rng.permutation(len(pdf)):
            state.move(i, rng)
        pdf["cluster_id"] = np.unique(state.z, return_inverse=True)[1].astype("int32")
        return pdf[["row_id", "chain", "view_id", "cluster_id"]]

    names = [s.name for s in specs]
    moved = model.assigned().select("row_id", *CLUSTER, *(c(f"`{n}`") for n in names)).groupBy("chain", "view_id").applyInPandas(run, "row_id long, chain int, view_id int, cluster_id int")
    parts = moved.groupBy("row_id").agg(F.collect_list(F.struct(*CLUSTER)).cast(PARTS).alias("parts"))
    return model.with_(rows=settle(model.rows.drop("parts").join(parts, "row_id").select(*model.rows.columns)))


def drawn_batch(model: Model, seed: int, batch_size: int) -> DataFrame:
    """assigned() of batch_size rows of each chain and view, drawn by hashes; place is the order in which they move."""
    order = W.partitionBy("chain", "view_id").orderBy(F.xxhash64(F.lit(seed), "row_id", "chain", "view_id"), "row_id")
    return model.assigned().withColumn("place", F.row_number().over(order)).where(c("place") <= batch_size)


def row_kernel_batch(model: Model, seed: int, batch_size: int) -> Model:
    """The sequential kernel over batch_size rows of each chain and view. A task gets these rows and the statistics of all
    clusters, not the other rows. Clusters keep their numbers; emptied ones are filled again before new numbers are used."""
    specs, hypers, alphas, views = model.columns, model.hypers, model.alphas, model.views
    names = [s.name for s in specs]
    batch = drawn_batch(model, seed, batch_size).select("row_id", *CLUSTER, "place", *(c(f"`{n}`").cast("double").alias(n) for n in names))
    stats = sizes(model).join(suffstats(model).select(*CLUSTER, "col_id", "n", "sx", "sxx", "ssin", "scos", "counts"), [*CLUSTER], "left")

    def of(s: ColumnSpec, own) -> np.ndarray:
        """Rows of ExactView.stat, summed, from rows of suffstats."""
        if s.stat_type == K.CONTINUOUS:
            return own[["n", "sx", "sxx"]].to_numpy(dtype=float)
        if s.stat_type == K.CYCLIC:
            return own[["n", "ssin", "scos"]].to_numpy(dtype=float)
        if s.stat_type == K.BINARY:
            ones = own["sx"].to_numpy(dtype=float)
            return np.column_stack([own["n"].to_numpy(dtype=float) - ones, ones, np.zeros((len(own), max(2, s.n_levels) - 2))])
        return np.stack([np.asarray(x, dtype=float) for x in own["counts"]])

    def run(key, rows, known):
        chain, view = (int(x) for x in key)
        own = [s for s in specs if views[chain, s.col_id] == view]
        rows = rows.sort_values("place", ignore_index=True)
        known = known.sort_values("cluster_id")
        by = {k: g for k, g in known.groupby("col_id")}
        first = known.drop_duplicates("cluster_id")
        labels = first["cluster_id"].to_numpy()
        z = np.searchsorted(labels, rows["cluster_id"].to_numpy())
        state = ExactView(rows[[s.name for s in own]].to_numpy(dtype=float), z, own, [hypers[chain, s.col_id] for s in own], alphas.get((chain, view), 1.0), (first["n_rows"].to_numpy(dtype=float), [of(s, by[s.col_id]) for s in own]))
        rng = np.random.default_rng([seed, chain, view])
        for i in range(len(rows)):
            state.move(i, rng)
        labels = np.concatenate([labels, labels.max() + 1 + np.arange(len(state.n) - len(labels))])
        rows["cluster_id"] = labels[state.z].astype("int32")
        return rows[["row_id", "chain", "view_id", "cluster_id"]]

    by = ("chain", "view_id")
    moved = batch.groupBy(*by).cogroup(stats.groupBy(*by)).applyInPandas(run, "row_id long, chain int, view_id int, cluster_id int")
    return _moved(model, moved)


# --- columns, hyper-parameters, concentrations ---------------------------------------------------------------------


def column_kernel(model: Model, seed: int, most: int | None = None) -> Model:
    """Each column drawn over the views and one fresh view, in turn. One job gives the marginal of every column under every
    view's partition; what is drawn on the driver are chains x columns numbers."""
    rng = np.random.default_rng([seed, 7])
    most = most or suggest_max_clusters(model.rows.count())
    fresh = {ch: max(v for (c2, _), v in model.views.items() if c2 == ch) + 1 for ch in model.chains}
    alphas = {ch: float(rng.gamma(1.0)) + 1e-3 for ch in model.chains}
    extra = F.array(*(F.struct(F.lit(ch).alias("chain"), F.lit(v).alias("view_id"), stick_cluster(seed * 7919 + ch, alphas[ch], most, "row_id", F.lit(ch)).cast("int").alias("cluster_id")) for ch, v in fresh.items())).cast(PARTS)
    rows = model.rows.withColumn("parts", F.concat("parts", extra))
    every = {(ch, v) for (ch, _), v in model.views.items()} | {*fresh.items()}
    # Every column is scored in every view: virtual chains, one for each view, hold all columns.
    number = {key: i for i, key in enumerate(sorted(every))}
    flat = F.transform("parts", lambda p: F.struct(_number(p, number).alias("chain"), F.lit(0).alias("view_id"), p["cluster_id"].alias("cluster_id"))).cast(PARTS)
    wide = Model(rows.withColumn("parts", flat), model.columns, {(i, s.col_id): 0 for i in number.values() for s in model.columns}, {(i, s.col_id): model.hypers[key[0], s.col_id] for key, i in number.items() for s in model.columns})
    found = suffstats(wide).groupBy("chain", "col_id").agg(F.sum(K.log_marginal()).alias("l")).collect()
    back = {i: key for key, i in number.items()}
    marginal = {(*back[r.chain], r.col_id): r.l for r in found}
    views = dict(model.views)
    for ch in model.chains:
        for s in model.columns:
            others = [views[ch, t.col_id] for t in model.columns if t.col_id != s.col_id]
            options = sorted({*others}) + [fresh[ch] if fresh[ch] not in others else None]
            alone = views[ch, s.col_id] not in others
            options[-1] = views[ch, s.col_id] if alone else options[-1]
            score = [(math.log(others.count(v)) if v in others else math.log(model.col_alphas.get(ch, 1.0))) + marginal[ch, v, s.col_id] for v in options if v is not None]
            views[ch, s.col_id] = [v for v in options if v is not None][int(np.argmax(np.array(score) + rng.gumbel(size=len(score))))]
    used = {(ch, v) for (ch, _), v in views.items()}
    keep = F.filter("parts", lambda p: _any_part(p, used))
    alpha = {k: a for k, a in model.alphas.items() if k in used} | {(ch, fresh[ch]): alphas[ch] for ch in model.chains if (ch, fresh[ch]) in used}
    return model.with_(rows=settle(rows.withColumn("parts", keep.cast(PARTS))), views=views, alphas=alpha)


def _number(p: Column, number: dict[tuple[int, int], int]) -> Column:
    out = F.lit(-1)
    for (ch, v), i in number.items():
        out = F.when((p["chain"] == ch) & (p["view_id"] == v), F.lit(i)).otherwise(out)
    return out


def _any_part(p: Column, used: set[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for ch, v in sorted(used):
        out = out | ((p["chain"] == ch) & (p["view_id"] == v))
    return out


def _grids(model: Model) -> dict[str, dict[str, tuple[str, Column]]]:
    """By type, in order: the hyper-parameter and its grid from (lo, hi, ssd, n) of the column."""
    from weftline.functions.math import linspace

    ln = lambda a, b: F.transform(linspace(F.log(a), F.log(b), GRID), F.exp)
    n = F.greatest(c("all_n"), F.lit(2)).cast("double")
    ssd = F.greatest(c("ssd"), F.lit(1e-6))
    return {
        K.CONTINUOUS: {"s": ln(ssd / 100, ssd), "mu": linspace(c("lo"), F.greatest(c("hi"), c("lo") + 1e-9), GRID), "nu": ln(F.lit(1.0), n), "r": ln(1 / n, n)},
        K.CATEGORICAL: {"dir_alpha": ln(1 / n, n)}, K.BINARY: {"alpha": ln(1 / n, n), "beta": ln(1 / n, n)},
        K.CYCLIC: {"vm_a": ln(1 / n, n), "vm_mu": linspace(F.lit(0.0), F.lit(2 * math.pi), GRID), "kappa": ln(F.lit(0.1), F.lit(100.0))}, K.ORDINAL: {"s": ln(F.lit(0.1), F.lit(100.0))},
    }


def hyper_kernel(model: Model, seed: int) -> Model:
    """Each hyper-parameter in turn drawn on a grid, given the statistics: no pass over the rows after the first."""
    spread = model.rows.agg(*(f(c(f"`{s.name}`")).alias(f"{k}{s.col_id}") for s in model.columns for k, f in (("lo", F.min), ("hi", F.max), ("v", F.var_pop), ("n", F.count)))).first()
    info = model.spark.createDataFrame([(s.col_id, float(spread[f"lo{s.col_id}"]), float(spread[f"hi{s.col_id}"]), float(spread[f"v{s.col_id}"] * spread[f"n{s.col_id}"]), spread[f"n{s.col_id}"]) for s in model.columns if spread[f"n{s.col_id}"]], "col_id int, lo double, hi double, ssd double, all_n long")
    stats = settle(suffstats(model))
    base = [x for x in stats.columns if x not in ("mu", "r", "s", "nu", "dir_alpha", "alpha", "beta", "kappa", "vm_a", "vm_mu", "cutpoints", "name", "stat_type", "n_levels")]
    hypers = {k: dict(h) for k, h in model.hypers.items()}
    for step in range(max(len(g) for g in _grids(model).values())):
        now = model.with_(hypers=hypers).hyper_table()
        found = None
        for kind, grid in _grids(model).items():
            if step >= len(grid) or all(s.stat_type != kind for s in model.columns):
                continue
            name = list(grid)[step]
            tried = stats.select(*base).join(now.where(c("stat_type") == kind), ["chain", "view_id", "col_id"]).join(info, "col_id").withColumn("g", F.explode(grid[name])).withColumn(name, c("g"))
            one = tried.groupBy("chain", "col_id", "g").agg(F.sum(K.log_marginal()).alias("l")).withColumn("l", c("l") + gumbel(seed + step, "chain", "col_id", "g"))
            one = one.groupBy("chain", "col_id").agg(F.max_by("g", "l").alias("g")).withColumn("h", F.lit(name))
            found = one if found is None else found.unionByName(one)
        for r in found.collect():  # chains x columns rows
            hypers[r.chain, r.col_id][r.h] = r.g
    return model.with_(hypers=hypers)


def draw_alpha(rng: np.random.Generator, counts: Sequence[int]) -> float:
    """On 31 points from 1 / N to N, under an Exp(1) prior."""
    n, k = sum(counts), len(counts)
    grid = np.exp(np.linspace(-math.log(max(n, 2)), math.log(max(n, 2)), GRID))
    score = [k * math.log(a) + math.lgamma(a) - math.lgamma(n + a) - a for a in grid]
    return float(grid[int(np.argmax(np.array(score) + rng.gumbel(size=GRID)))])


def alpha_kernel(model: Model, seed: int) -> Model:
    rng = np.random.default_rng([seed, 11])
    found = sizes(model).groupBy("chain", "view_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_rows").alias("n")).collect()
    alphas = {(r.chain, r.view_id): draw_alpha(rng, [r.n - r.k + 1, *[1] * (r.k - 1)]) for r in sorted(found)}
    cols = {ch: draw_alpha(rng, list(np.unique([v for (c2, _), v in model.views.items() if c2 == ch], return_counts=True)[1])) for ch in model.chains}
    return model.with_(alphas=alphas, col_alphas=cols)


def sweep(model: Model, seed: int, kernels: Sequence[str] = KERNELS, exact: bool = False, batch_size: int | None = None) -> Model:
    steps = {"rows": lambda m: row_kernel_exact(m, seed, batch_size) if exact or batch_size else row_kernel(m, seed), "columns": lambda m: column_kernel(m, seed), "hypers": lambda m: hyper_kernel(m, seed), "alphas": lambda m: alpha_kernel(m, seed)}
    for k in kernels:
        model = steps[k](model)
    return model


def fit(model: Model, n_sweeps: int, seed: int = 0, exact_every: int = 0, patience: int = 0, check_every: int = 5, min_gain: float = 1e-3, **options) -> tuple[Model, list[dict]]:
    """n_sweeps sweeps; every exact_every-th by the exact row kernel; with patience, early stop when the best chain's relative gain
    stays under min_gain for so many checks, or is not finite. Gives the model and a trace of log joints."""
    trace: list[dict] = []
    last, poor = None, 0
    for k in range(n_sweeps):
        model = sweep(model, seed + k, exact=bool(exact_every) and (k + 1) % exact_every == 0, **options)
        if (k + 1) % check_every == 0 or k + 1 == n_sweeps:
            scores = {r.chain: r.log_joint for r in log_joint(model).collect()}
            trace += [{"sweep": k + 1, "chain": ch, "log_joint": v} for ch, v in scores.items()]
            best = max(scores.values())
            if patience and last is not None:
                poor = poor + 1 if not math.isfinite(best) or (best - last) / max(abs(last), 1) < min_gain else 0
                if poor >= patience:
                    break
            last = best if last is None else max(last, best)
    return model, trace


def anneal(rows: DataFrame, specs: Sequence[ColumnSpec], initial_size: int, growth: float = 2.0, sweeps_per_stage: int = 5, seed: int = 0, **options) -> Model:
    """Fit on a hashed subsample, then grow it by inserting rows and sweeping again, until all rows are in."""
    if growth <= 1 or initial_size < 1:
        raise ValueError("growth must be over 1 and the first size at least 1")
    from weftline.streaming.insert import insert_rows

    total = rows.count()
    size = min(initial_size, total)
    placed = uniform(seed, "row_id")
    below = 0.0
    share = size / total
    model = initialize(rows.where(placed < share), specs, seed=seed, **options)
    columns, hypers = default_hypers(rows, list(specs))
    model = model.with_(columns=columns, hypers={k: dict(hypers[k[1]]) for k in model.views})
    while True:
        model, _ = fit(model, sweeps_per_stage, seed)
        if share >= 1:
            return model
        below, share = share, min(1.0, share * growth)
        model = insert_rows(model, rows.where((placed >= below) & (placed < share if share < 1 else F.lit(True))), seed)


def enforce_columns(model: Model, constraints: Sequence[tuple[int, int, bool]], attempts: int = 20, seed: int = 0) -> tuple[Model, int]:
    """Sweeps until every chain satisfies the column constraints; ValueError after the last attempt."""
    ok = lambda m: all((m.views[ch, a] == m.views[ch, b]) == dep for ch in m.chains for a, b, dep in constraints)
    for k in range(attempts):
        if ok(model):
            return model, k
        model = sweep(model, seed + k)
    if not ok(model):
        raise ValueError(f"not satisfied after {attempts} sweeps")
    return model, attempts


def enforce_rows(model: Model, constraints: DataFrame, view_id: int | None = None, attempts: int = 20, seed: int = 0, kernels: Sequence[str] = ("rows",)) -> tuple[Model, int]:
    """Sweeps until every chain satisfies the row constraints (row_a, row_b, dependent), in all views or the one given; the
    model and the number of sweeps, or ValueError after the last attempt."""
    for k in range(attempts + 1):
        if check_row_constraints(model, constraints, view_id).where("not satisfied").isEmpty():
            return model, k
        if k < attempts:
            model = sweep(model, seed + k, kernels)
    raise ValueError(f"not satisfied after {attempts} sweeps")
