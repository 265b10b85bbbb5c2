"""Deterministic queries on a model: DataFrame in, DataFrame out, all rows and chains at once.

A query with several chains averages over them where that is its meaning (Bayesian model averaging). Statistics and
scorers are small tables whose joins are left to the optimizer, which broadcasts them by their measured size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.math import LOG_EPS, cosine, lgamma
from weftline.operators import arrays
from weftline.operators import components as K
from weftline.operators.suffstats import scorers, sizes, suffstats
from weftline.plans.model import Model
from weftline.plans.store import settle

c = F.col
CLUSTER = ["chain", "view_id", "cluster_id"]


def grouped_logsumexp(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """ln sum exp by group, shifted by the group's maximum."""
    v = df.withColumn("_v", value)
    top = v.groupBy(*keys).agg(F.max("_v").alias("_m"))
    return v.join(top, [*keys]).groupBy(*keys).agg((F.log(F.sum(F.exp(c("_v") - c("_m")))) + F.max("_m")).alias(name))


def log_mean_exp(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Over chains: ln of the mean probability."""
    agg = F.collect_list(value)  # as many values as chains
    xs = df.groupBy(*keys).agg(agg.alias("_xs"))
    top = F.array_max("_xs")
    return xs.select(*keys, (F.log(F.aggregate("_xs", F.lit(0.0), lambda a, x: a + F.exp(x - top)) / F.size("_xs")) + top).alias(name))


def cell_scores(model: Model, rows: DataFrame | None = None) -> DataFrame:
    """ln p of every observed cell under its own row's cluster (a direct join, no mixture)."""
    need = ["stat_type", "p0", "p1", "p2", "p3", "levels"]
    return model.cells(rows).join(scorers(model).select(*CLUSTER, "col_id", "name", *need), [*CLUSTER, "col_id"]).withColumn("logp", K.cell_logp(c("x"))).drop(*need)


# --- anomaly -------------------------------------------------------------------------------------------------------


def anomaly_scores(model: Model, rows: DataFrame | None = None) -> DataFrame:
    """1 / (1 + exp(mean log p + 2)) by row, averaged over chains; 0.5 for a row without observed cells. Rows stay where they are."""
    return arrays.anomalies(model, model.rows if rows is None else rows, scorers(model))


def anomaly_cells(model: Model, rows: DataFrame | None = None) -> DataFrame:
    """Per-cell drill-down: mean over chains of ln p, lowest first within a row."""
    return cell_scores(model, rows).groupBy("row_id", "col_id", "name").agg(F.avg("logp").alias("logp")).withColumn("place", F.row_number().over(W.partitionBy("row_id").orderBy("logp", "col_id")))


def top_anomalies(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.desc("anomaly"), "row_id").limit(n)


def anomaly_ranks(scores: DataFrame) -> DataFrame:
    """scores with rank_share, the share of rows whose score is lower. Equal scores are counted first and ranges of scores
    after that, so no task holds them all."""
    by = settle(scores.groupBy("anomaly").agg(F.count(F.lit(1)).alias("k")).repartitionByRange("anomaly").withColumn("part", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum("k").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = by.groupBy("part").agg(F.sum("k").alias("k")).select("part", before(W.orderBy("part")).alias("start"), F.sum("k").over(W.partitionBy()).alias("all"))  # a row for each range
    ranks = by.withColumn("below", before(W.partitionBy("part").orderBy("anomaly"))).join(starts, "part")
    return scores.join(ranks.select("anomaly", ((c("start") + c("below")) / c("all")).alias("rank_share")), "anomaly")


def anomaly_thresholds(scores: DataFrame, percentile: float = 0.95, sigmas: float = 2.0) -> DataFrame:
    """Cut-offs by percentile, mean + sigmas * sd, and upper quartile + 1.5 interquartile ranges."""
    q = scores.agg(F.percentile("anomaly", F.array(F.lit(percentile), F.lit(0.25), F.lit(0.75))).alias("q"), F.avg("anomaly").alias("mean"), F.stddev_pop("anomaly").alias("sd"))
    return q.select(c("q")[0].alias("by_percentile"), (c("mean") + sigmas * c("sd")).alias("by_sigma"), (c("q")[2] + 1.5 * (c("q")[2] - c("q")[1])).alias("by_iqr"))


def drift_check(baseline: DataFrame, batch: DataFrame, limit: float = 2.0) -> DataFrame:
    """z of the batch's mean anomaly against the baseline's scores."""
    base = baseline.agg(F.avg("anomaly").alias("base_mean"), F.stddev_pop("anomaly").alias("base_sd"))
    new = batch.agg(F.avg("anomaly").alias("batch_mean"), F.count(F.lit(1)).alias("n_batch"))
    z = F.when(c("base_sd") > 0, (c("batch_mean") - c("base_mean")) / c("base_sd")).otherwise(0.0)
    return base.crossJoin(new).withColumn("z", z).withColumn("drift", F.abs("z") > limit)  # one row each


# --- probabilities -------------------------------------------------------------------------------------------------


def cluster_weights(model: Model, conditions: DataFrame | None = None) -> DataFrame:
    """(query_id,) chain, view_id, cluster_id, lw: ln n_c / N, or with conditions (query_id, col_id, value) the softmax of
    ln n_c plus the log-likelihood of the query's conditions in that view. Missing condition values are ignored."""
    counts = sizes(model)
    if conditions is None:
        total = F.sum("n_rows").over(W.partitionBy("chain", "view_id"))
        return counts.select(*CLUSTER, F.log(c("n_rows") / total).alias("lw"))
    sc = scorers(model)
    given_ = conditions.where("value is not null and not isnan(value)").join(sc, "col_id").withColumn("logp", K.cell_logp(c("value"))).groupBy("query_id", *CLUSTER).agg(F.sum("logp").alias("ll"))
    every = _each_query(conditions, counts)
    raw = every.join(given_, ["query_id", *CLUSTER], "left").withColumn("raw", F.log("n_rows") + F.coalesce("ll", F.lit(0.0)))
    norm = grouped_logsumexp(raw, ["query_id", "chain", "view_id"], c("raw"), "norm")
    return raw.join(norm, ["query_id", "chain", "view_id"]).select("query_id", *CLUSTER, (c("raw") - c("norm")).alias("lw"))


def _each_query(conditions: DataFrame, counts: DataFrame) -> DataFrame:
    """Each query with every cluster: clusters gather in one bounded array (chains x views x clusters), then unfold."""
    return conditions.select("query_id").distinct().join(counts.agg(F.collect_list(F.struct(*CLUSTER, "n_rows")).alias("all")), F.lit(True)).select("query_id", F.inline("all"))


def cell_mixture(model: Model, queries: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(query_id, chain, col_id, logp): mixture log-probability of each query cell (query_id, col_id, value)."""
    weights = cluster_weights(model) if weights is None else weights
    keys = [*(["query_id"] if "query_id" in weights.columns else []), *CLUSTER]
    scored = queries.join(scorers(model), "col_id").withColumn("logp", K.cell_logp(c("value"))).join(weights, keys)
    return grouped_logsumexp(scored, ["query_id", "chain", "view_id", "col_id"], c("lw") + c("logp"), "logp")


def predictive_probability(model: Model, queries: DataFrame, conditions: DataFrame | None = None, by_chain: bool = False) -> DataFrame:
    """ln p of each query's cells, columns independent given the weights; log-mean-exp over chains."""
    weights = cluster_weights(model, conditions) if conditions is not None else None
    each = cell_mixture(model, queries, weights).groupBy("query_id", "chain").agg(F.sum("logp").alias("logp"))
    return each if by_chain else log_mean_exp(each, ["query_id"], "logp", "logp")


def row_predictive_probability(model: Model, queries: DataFrame) -> DataFrame:
    """ln p of cells (query_id, row_id, col_id, value) for observed rows: the weight is one on the row's own cluster."""
    parts = model.assigned(model.rows.join(queries.select("row_id").distinct(), "row_id", "left_semi")).select("row_id", *CLUSTER)
    each = queries.join(parts, "row_id").join(scorers(model), [*CLUSTER, "col_id"]).withColumn("logp", K.cell_logp(c("value"))).groupBy("query_id", "chain").agg(F.sum("logp").alias("logp"))
    return log_mean_exp(each, ["query_id"], "logp", "logp")


def joint_probability(model: Model, queries: DataFrame, conditions: DataFrame | None = None, independent: bool = False) -> DataFrame:
    """ln p of each query's cells together: within a view by ln sum_c w_c prod_j p_j (the chain rule in closed form)."""
    if independent:
        return predictive_probability(model, queries, conditions)
    weights = cluster_weights(model) if conditions is None else cluster_weights(model, conditions)
    keys = [*(["query_id"] if "query_id" in weights.columns else []), *CLUSTER]
    scored = queries.join(scorers(model), "col_id").withColumn("logp", K.cell_logp(c("value"))).groupBy("query_id", *CLUSTER).agg(F.sum("logp").alias("logp")).join(weights, keys)
    by_view = grouped_logsumexp(scored, ["query_id", "chain", "view_id"], c("lw") + c("logp"), "logp")
    return log_mean_exp(by_view.groupBy("query_id", "chain").agg(F.sum("logp").alias("logp")), ["query_id"], "logp", "logp")


def level_probabilities(model: Model, weights: DataFrame | None = None) -> DataFrame:
    """(query_id,) chain, view_id, col_id, level, logp for every level of the discrete columns."""
    weights = cluster_weights(model) if weights is None else weights
    extra = ["query_id"] if "query_id" in weights.columns else []
    lv = scorers(model).where("levels is not null").join(weights, CLUSTER).select(*extra, *CLUSTER, "col_id", "name", "lw", F.posexplode("levels").alias("level", "lp"))
    return grouped_logsumexp(lv, [*extra, "chain", "view_id", "col_id", "name", "level"], c("lw") + c("lp"), "logp")


def discrete_cdf(model: Model, conditions: DataFrame | None = None) -> DataFrame:
    """(query_id,) col_id, level, cdf: sum of level probabilities up to each level, mean over chains, within [0, 1]."""
    lv = level_probabilities(model, None if conditions is None else cluster_weights(model, conditions))
    extra = ["query_id"] if conditions is not None else []
    order = W.partitionBy(*extra, "chain", "col_id").orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    run = lv.withColumn("cdf", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(F.exp("logp")).over(order))))
    return run.groupBy(*extra, "col_id", "name", "level").agg(F.avg("cdf").alias("cdf"))


def row_level_scores(model: Model, col_ids: Sequence[int], rows: DataFrame | None = None) -> DataFrame:
    """(row_id, col_id, level, logp): ln p of each level under the row's clusters, log-mean-exp over chains."""
    sc = scorers(model).where(c("col_id").isin(*col_ids) & c("levels").isNotNull()).select(*CLUSTER, "col_id", "levels")
    lv = model.assigned(rows).select("row_id", *CLUSTER).join(sc, CLUSTER)
    # As many arrays as chains for a row and column: the mean over chains is taken within the row.
    gathered = lv.groupBy("row_id", "col_id").agg(F.collect_list("levels").alias("all"))
    mean = F.transform(F.sequence(F.lit(0), F.size(c("all")[0]) - 1), lambda i: F.log(F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(F.get(x, i))) / F.size("all")))
    return gathered.select("row_id", "col_id", F.posexplode(mean).alias("level", "logp"))


def classify(model: Model, col_id: int, rows: DataFrame | None = None) -> DataFrame:
    """Most probable level of a discrete column for each row; ties go to the smaller level."""
    lv = row_level_scores(model, [col_id], rows)
    return lv.groupBy("row_id").agg(F.max_by("level", F.struct(c("logp"), -c("level"))).alias("level"), F.max("logp").alias("logp"))


def binary_scores(model: Model, col_ids: Sequence[int], rows: DataFrame | None = None) -> DataFrame:
    """P(column = 1 | row), normalised over {0, 1}."""
    lv = row_level_scores(model, col_ids, rows)
    p = lv.groupBy("row_id", "col_id").agg(F.max(F.when(c("level") == 0, F.exp("logp"))).alias("p0"), F.max(F.when(c("level") == 1, F.exp("logp"))).alias("p1"))
    return p.select("row_id", "col_id", (c("p1") / (c("p0") + c("p1"))).alias("p1"))


def impute_discrete(model: Model, col_id: int, rows: DataFrame | None = None) -> DataFrame:
    """The exact variant of imputation: the most probable level and its probability as confidence."""
    return classify(model, col_id, rows).select("row_id", c("level").alias("value"), F.exp("logp").alias("confidence"))


def mean_log_likelihood(model: Model, held_out: DataFrame) -> DataFrame:
    """Mean over cells (row_id, col_id, value) of ln p under the row's own clusters, by column and in all."""
    parts = model.assigned(model.rows.join(held_out.select("row_id").distinct(), "row_id", "left_semi")).select("row_id", *CLUSTER)
    scored = held_out.where("value is not null").join(parts, "row_id").join(scorers(model), [*CLUSTER, "col_id"]).withColumn("logp", K.cell_logp(c("value")))
    return scored.groupBy("col_id", "name").agg(F.avg("logp").alias("mean_logp"), F.count(F.lit(1)).alias("n"))


# --- structure -----------------------------------------------------------------------------------------------------


def crp_logp(counts: DataFrame, keys: Sequence[str], n: str, alpha: Column) -> DataFrame:
    """K ln alpha + sum ln Gamma(n_k) - ln Gamma(N + alpha) + ln Gamma(alpha), by keys; alpha from an aggregate of a column."""
    s = counts.withColumn("_a", alpha).groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.sum(n).alias("_n"), F.sum(lgamma(c(n).cast("double"))).alias("_g"), F.max("_a").alias("_a"))
    return s.select(*keys, (c("_k") * F.log("_a") + c("_g") - lgamma(c("_n") + c("_a")) + lgamma(c("_a"))).alias("crp"), c("_k").alias("n_clusters"), c("_a").alias("alpha"))


def alpha_of(model: Model) -> Column:
    out = F.lit(1.0)
    for (chain, view), a in model.alphas.items():
        out = F.when((c("chain") == chain) & (c("view_id") == view), F.lit(float(a))).otherwise(out)
    return out


def col_alpha_of(model: Model) -> Column:
    out = F.lit(1.0)
    for chain, a in model.col_alphas.items():
        out = F.when(c("chain") == chain, F.lit(float(a))).otherwise(out)
    return out


def log_joint(model: Model) -> DataFrame:
    """By chain: CRP of columns and of each view's rows, marginals of all clusters, Exp(1) priors of the concentrations."""
    marginal = suffstats(model).groupBy("chain").agg(F.sum(K.log_marginal()).alias("marginal"))
    rows = crp_logp(sizes(model), ["chain", "view_id"], "n_rows", alpha_of(model)).groupBy("chain").agg(F.sum(c("crp") - c("alpha")).alias("rows"))
    cols = crp_logp(model.col_partition().groupBy("chain", "view_id").agg(F.count(F.lit(1)).alias("n")), ["chain"], "n", col_alpha_of(model)).select("chain", (c("crp") - c("alpha")).alias("cols"))
    return marginal.join(rows, "chain").join(cols, "chain").select("chain", (c("marginal") + c("rows") + c("cols")).alias("log_joint"))


def structure(model: Model) -> DataFrame:
    """By chain and view: columns, number of clusters, rows, largest cluster, concentration."""
    names = model.hyper_table().groupBy("chain", "view_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_id", "name"))), lambda x: x["name"]), ",").alias("columns"))
    s = sizes(model).withColumn("alpha", alpha_of(model)).groupBy("chain", "view_id").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n_rows").alias("n_rows"), F.max("n_rows").alias("largest"), F.max("alpha").alias("alpha"))
    return names.join(s, ["chain", "view_id"])


def dependence(model: Model) -> DataFrame:
    """Share of chains in which two columns lie in one view, for all pairs i < j."""
    p = model.col_partition()
    a, b = p.alias("a"), p.alias("b")
    both = a.join(b, (c("a.chain") == c("b.chain")) & (c("a.col_id") < c("b.col_id")))
    return both.groupBy(c("a.col_id").alias("col_i"), c("b.col_id").alias("col_j")).agg(F.avg((c("a.view_id") == c("b.view_id")).cast("double")).alias("dependence"))


def top_dependence(model: Model, k: int) -> DataFrame:
    return dependence(model).orderBy(F.desc("dependence"), "col_i", "col_j").limit(k)


def column_typicality(model: Model) -> DataFrame:
    """1 - entropy / ln(number of others) of a column's co-occurrence with the others; 0.5 with one chain or no mass."""
    n = len(model.columns) - 1
    if len(model.chains) <= 1 or n < 1:
        return model.spark.createDataFrame([(s.col_id, s.name, 0.5) for s in model.columns], "col_id int, name string, typicality double")
    d = dependence(model)
    both = d.select(c("col_i").alias("col_id"), "dependence").unionByName(d.select(c("col_j").alias("col_id"), "dependence"))
    total = F.sum("dependence").over(W.partitionBy("col_id"))
    p = both.withColumn("p", F.when(total > 0, c("dependence") / total))
    e = p.groupBy("col_id").agg(F.sum(F.when(c("p") > 0, -c("p") * F.log(c("p"))).otherwise(0.0)).alias("e"), F.max("p").alias("top"))
    names = model.spark.createDataFrame([(s.col_id, s.name) for s in model.columns], "col_id int, name string")
    return names.join(e, "col_id").select("col_id", "name", F.when(c("top").isNull(), 0.5).otherwise(1 - c("e") / math.log(max(n, 2))).alias("typicality"))


def row_typicality(model: Model, rows: DataFrame | None = None) -> DataFrame:
    """Share of rows in clusters no larger than mine, mean over views, then over chains."""
    order = W.partitionBy("chain", "view_id").orderBy("n_rows").rangeBetween(W.unboundedPreceding, 0)
    total = F.sum("n_rows").over(W.partitionBy("chain", "view_id"))
    t = sizes(model).select(*CLUSTER, (F.sum("n_rows").over(order) / total).alias("t"))
    each = model.assigned(rows).select("row_id", *CLUSTER).join(t, CLUSTER).groupBy("row_id", "chain").agg(F.avg("t").alias("t"))
    return each.groupBy("row_id").agg(F.avg("t").alias("typicality"))


def row_similarity(model: Model, pairs: DataFrame, target_columns: Sequence[int] | None = None) -> DataFrame:
    """For pairs (row_a, row_b): share of views with one cluster, mean over chains; views holding target columns only, if
    given; chains without such a view are skipped, 0 where none is left."""
    wanted = None if target_columns is None else {(ch, v) for (ch, col), v in model.views.items() if col in {*target_columns}}
    parts = model.assigned(model.rows.join(pairs.select(F.explode(F.array("row_a", "row_b")).alias("row_id")).distinct(), "row_id", "left_semi")).select("row_id", *CLUSTER)
    if wanted is not None:
        keep = F.lit(False)
        for ch, v in sorted(wanted):
            keep = keep | ((c("chain") == ch) & (c("view_id") == v))
        parts = parts.where(keep)
    a, b = (parts.select(c("row_id").alias(f"row_{x}"), "chain", "view_id", c("cluster_id").alias(f"c{x}")) for x in "ab")
    same = pairs.join(a, "row_a").join(b, ["row_b", "chain", "view_id"]).groupBy("row_a", "row_b", "chain").agg(F.avg((c("ca") == c("cb")).cast("double")).alias("s"))
    found = same.groupBy("row_a", "row_b").agg(F.avg("s").alias("similarity"))
    return pairs.join(found, ["row_a", "row_b"], "left").select("row_a", "row_b", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def nearest_rows(model: Model, query_rows: DataFrame, k: int) -> DataFrame:
    """The k rows most similar to each query row (row_a): rows that share a cluster meet on it; self is left out."""
    parts = model.assigned().select("row_id", *CLUSTER)
    per_chain = {ch: len({v for (c2, _), v in model.views.items() if c2 == ch}) for ch in model.chains}
    weight = F.lit(0.0)
    for ch, n in per_chain.items():
        weight = F.when(c("chain") == ch, F.lit(1.0 / n / len(per_chain))).otherwise(weight)
    mine = query_rows.select("row_a").join(parts.select(c("row_id").alias("row_a"), *CLUSTER), "row_a")
    met = mine.join(parts.select(c("row_id").alias("row_b"), *CLUSTER), CLUSTER).where("row_a <> row_b").groupBy("row_a", "row_b").agg(F.sum(weight).alias("similarity"))
    place = F.row_number().over(W.partitionBy("row_a").orderBy(F.desc("similarity"), "row_b"))
    return met.withColumn("place", place).where(c("place") <= k)


def segment_profile(model: Model) -> DataFrame:
    """By cluster and column: mean, sd, share of ones, mode, circular mean and sd as the type has it, and z of the mean."""
    ss = suffstats(model).where("n > 0")
    mean = c("sx") / c("n")
    sd = F.sqrt(F.greatest(c("sxx") / c("n") - mean * mean, F.lit(0.0)))
    whole = W.partitionBy("chain", "col_id")
    all_n, all_s, all_q = (F.sum(x).over(whole) for x in ("n", "sx", "sxx"))
    all_mean = all_s / all_n
    all_sd = F.sqrt(F.greatest(all_q / all_n - all_mean * all_mean, F.lit(0.0)))
    r = F.sqrt(c("ssin") * c("ssin") + c("scos") * c("scos")) / c("n")
    mode = F.array_position("counts", F.array_max("counts")).cast("int") - 1
    discrete = c("stat_type").isin(K.CATEGORICAL, K.ORDINAL)
    return ss.select(
        *CLUSTER, "col_id", "name", "stat_type", "n", F.when(c("stat_type").isin(K.CONTINUOUS, K.BINARY, K.ORDINAL), mean).alias("mean"), F.when(c("stat_type") == K.CONTINUOUS, sd).alias("sd"),
        F.when(c("stat_type") == K.CONTINUOUS, F.when(all_sd > 0, (mean - all_mean) / all_sd).otherwise(0.0)).alias("z"),
        F.when(discrete, mode).alias("mode"), F.when(discrete, F.array_max("counts") / c("n")).alias("mode_share"),
        F.when(c("stat_type") == K.CYCLIC, F.pmod(F.atan2("ssin", "scos"), F.lit(2 * math.pi))).alias("circular_mean"),
        F.when(c("stat_type") == K.CYCLIC, F.sqrt(-2 * F.log(F.greatest(F.least(r, F.lit(1.0)), F.lit(LOG_EPS))))).alias("circular_sd"),
    )


def fingerprints(model: Model, entities: DataFrame) -> DataFrame:
    """(entity, fingerprint): distribution of an entity's rows over clusters, all views side by side, mean over chains.

    entities: (row_id, entity). Cluster places run to the largest number over chains in a view; a chain that lacks a
    view counts as uniform there."""
    width: dict[int, int] = {}
    for r in sizes(model).groupBy("view_id").agg(F.max("cluster_id").alias("k")).toLocalIterator():  # views x chains rows
        width[r.view_id] = max(width.get(r.view_id, 0), r.k + 1)
    counts = model.assigned(model.rows.select("row_id", "parts").join(entities, "row_id")).groupBy("entity", *CLUSTER).agg(F.count(F.lit(1)).alias("k"))
    share = counts.withColumn("p", c("k") / F.sum("k").over(W.partitionBy("entity", "chain", "view_id")))
    maps = share.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*CLUSTER), "p"))).alias("m"))
    key = lambda ch, v, k: F.struct(F.lit(ch).alias("chain"), F.lit(v).alias("view_id"), F.lit(k).alias("cluster_id"))
    chains = {v: [ch for ch in model.chains if v in {x for (c2, _), x in model.views.items() if c2 == ch}] for v in width}
    cells = []
    for v in sorted(width):
        for k in range(width[v]):
            total = F.lit((len(model.chains) - len(chains[v])) / width[v])
            for ch in chains[v]:
                total = total + F.coalesce(F.try_element_at("m", key(ch, v, k)), F.lit(0.0))
            cells.append(total / len(model.chains))
    return maps.select("entity", F.array(*cells).alias("fingerprint"))


def fingerprint_similarity(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    a, b = (prints.select(c("entity").alias(f"entity_{x}"), c("fingerprint").alias(f"f{x}")) for x in "ab")
    return pairs.join(a, "entity_a").join(b, "entity_b").select("entity_a", "entity_b", cosine(c("fa"), c("fb")).alias("similarity"))


# --- information ---------------------------------------------------------------------------------------------------


def _pair_levels(model: Model, i: int, j: int) -> DataFrame:
    sc, w = scorers(model).where("levels is not null"), cluster_weights(model)
    a = sc.where(c("col_id") == i).select(*CLUSTER, F.posexplode("levels").alias("a", "la"))
    b = sc.where(c("col_id") == j).select(*CLUSTER, F.posexplode("levels").alias("b", "lb"))
    joint = a.join(b, CLUSTER).join(w, CLUSTER).groupBy("chain", "view_id", "a", "b").agg(F.sum(F.exp(c("lw") + c("la") + c("lb"))).alias("p"))
    pa, pb = (F.sum("p").over(W.partitionBy("chain", x)) for x in ("a", "b"))
    return joint.withColumn("pa", pa).withColumn("pb", pb)


def mutual_information_discrete(model: Model, i: int, j: int) -> DataFrame:
    """Exact for two discrete columns, by enumeration: 0 in chains where their views differ, mean over chains, with Linfoot."""
    chains = model.spark.createDataFrame([(ch,) for ch in model.chains], "chain int")
    mi = _pair_levels(model, i, j).groupBy("chain").agg(F.greatest(F.lit(0.0), F.sum(c("p") * F.log(c("p") / (c("pa") * c("pb"))))).alias("mi"))
    mean = chains.join(mi, "chain", "left").agg(F.avg(F.coalesce("mi", F.lit(0.0))).alias("mi"))
    return mean.select(F.lit(i).alias("col_i"), F.lit(j).alias("col_j"), "mi", F.sqrt(1 - F.exp(-2 * c("mi"))).alias("linfoot"))


def conditional_entropy_discrete(model: Model, target: int, given_: int) -> DataFrame:
    """Exact H(target | given) of two discrete columns, mean over chains; the marginal entropy where views differ."""
    chains = model.spark.createDataFrame([(ch,) for ch in model.chains], "chain int")
    h = _pair_levels(model, target, given_).groupBy("chain").agg((-F.sum(c("p") * F.log(c("p") / c("pb")))).alias("h"))
    lv = level_probabilities(model).where(c("col_id") == target).groupBy("chain").agg((-F.sum(F.exp("logp") * c("logp"))).alias("m"))
    return chains.join(h, "chain", "left").join(lv, "chain").agg(F.avg(F.coalesce("h", "m")).alias("entropy")).select(F.lit(target).alias("target"), F.lit(given_).alias("given_col"), "entropy")
