"""Limits on a model's size, and what its tables weigh."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from weftline.operators import components as K
from weftline.operators.suffstats import sizes
from weftline.plans.model import Model

c = F.col
POLICIES = ("warn", "raise", "ignore")
#: Bytes of a number in memory, and of a part: three 32-bit numbers.
NUMBER, PART = 8, 12


class Overflow(ValueError):
    """A model over its limits."""


def check_budget(model: Model, max_views: int | None = None, max_clusters: int | None = None, policy: str = "warn") -> list[dict]:
    """Chains of more than max_views views and views of more than max_clusters clusters, as {what, chain, view_id, count,
    limit}; a warning or Overflow if there are any. Nothing is cut off: assignments beyond a limit stay valid."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    over = []
    for ch in model.chains if max_views is not None else ():
        n = len({v for (c2, _), v in model.views.items() if c2 == ch})
        if n > max_views:
            over.append({"what": "views", "chain": ch, "view_id": None, "count": n, "limit": max_views})
    if max_clusters is not None:
        many = sizes(model).groupBy("chain", "view_id").agg(F.count(F.lit(1)).alias("k")).where(c("k") > max_clusters)
        over += [{"what": "clusters", "chain": r.chain, "view_id": r.view_id, "count": r.k, "limit": max_clusters} for r in sorted(many.collect())]  # chains x views rows
    if over and policy != "ignore":
        text = "; ".join(f"{o['count']} {o['what']} in chain {o['chain']}" + (f", view {o['view_id']}" if o["view_id"] is not None else "") + f" (limit {o['limit']})" for o in over)
        if policy == "raise":
            raise Overflow(text)
        warnings.warn(text, stacklevel=2)
    return over


def estimate_memory(model: Model) -> dict[str, int]:
    """Bytes by table, uncompressed, and in all: rows with their cells and parts, statistics, scorers, hyper-parameters."""
    n_rows = model.rows.count()
    clusters = {(r.chain, r.view_id): r.k for r in sizes(model).groupBy("chain", "view_id").agg(F.count(F.lit(1)).alias("k")).collect()}  # chains x views rows
    pairs = [(s, clusters.get((ch, model.views[ch, s.col_id]), 0)) for ch in model.chains for s in model.columns]
    levels = lambda s: s.n_levels if s.stat_type in (K.CATEGORICAL, K.ORDINAL, K.BINARY) else 0
    found = {
        "cells": n_rows * len(model.columns) * NUMBER, "row_ids": n_rows * NUMBER, "parts": n_rows * len(set((ch, v) for (ch, _), v in model.views.items())) * PART,
        "statistics": sum(k * (5 + levels(s)) * NUMBER for s, k in pairs), "scorers": sum(k * (4 + levels(s)) * NUMBER for s, k in pairs),
        "hypers": len(pairs) * 10 * NUMBER + sum(max(levels(s) - 1, 0) * NUMBER for s, _ in pairs if s.stat_type == K.ORDINAL),
    }
    return found | {"total": sum(found.values())}
