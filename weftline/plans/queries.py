"""Registered queries over the given tables and, for the deterministic ones, the same in DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import components as K
from weftline.operators import constraints, diagnostics, ingest
from weftline.operators import queries as Q
from weftline.operators.suffstats import suffstats
from weftline.plans.fixtures import BASE, MARGINAL, VIEWS, logp_sql, orders_model, orders_rows

c = F.col
r6 = lambda x: F.round(x, 6)
QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Cells asked for by id, and conditions on them; values as in the fixture's columns.
ASKED = [(1, 0, 150000.0), (1, 2, 1.0), (1, 5, 1.0), (2, 3, 1.0), (2, 4, 2.0), (3, 1, 0.0), (3, 0, 250000.0), (3, 3, 0.0)]
CONDITIONS = [(1, 1, 5000.0), (1, 4, 3.0), (2, 0, 90000.0), (2, 5, 2.0), (3, 2, 4.0)]
_values = lambda rows: ", ".join(str(r) for r in rows)
ASKED_SQL = f"asked(query_id, col_id, x) AS (VALUES {_values(ASKED)}), conditions(query_id, col_id, x) AS (VALUES {_values(CONDITIONS)}), "
WEIGHTS = "weights AS (SELECT chain, view_id, cluster_id, ln(n_rows * 1.0 / sum(n_rows) OVER (PARTITION BY chain, view_id)) AS lw FROM sizes), "
WEIGHTED = f"""every AS (SELECT q.query_id, s.* FROM (SELECT DISTINCT query_id FROM conditions) q, sizes s),
cond AS (SELECT c.query_id, cp.chain, cp.view_id, s.cluster_id, c.col_id, c.x FROM conditions c JOIN cp ON cp.col_id = c.col_id JOIN sizes s ON s.chain = cp.chain AND s.view_id = cp.view_id),
condl AS (SELECT query_id, chain, view_id, cluster_id, sum(logp) AS ll FROM ({logp_sql("cond")}) GROUP BY ALL),
weights AS (SELECT e.query_id, e.chain, e.view_id, e.cluster_id, ln(n_rows) + coalesce(ll, 0) - ln(sum(n_rows * exp(coalesce(ll, 0))) OVER (PARTITION BY e.query_id, e.chain, e.view_id)) AS lw FROM every e LEFT JOIN condl l ON l.query_id = e.query_id AND l.chain = e.chain AND l.view_id = e.view_id AND l.cluster_id = e.cluster_id), """
ASKED_CELLS = "ac AS (SELECT a.query_id, cp.chain, cp.view_id, s.cluster_id, a.col_id, a.x FROM asked a JOIN cp ON cp.col_id = a.col_id JOIN sizes s ON s.chain = cp.chain AND s.view_id = cp.view_id), "


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql if sql.lstrip().startswith(("WITH", "SELECT")) else BASE.rstrip().rstrip(",") + ", " + sql
        return f

    return put


def asked(spark: SparkSession, rows: list, schema: str = "query_id int, col_id int, value double") -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- statistics and components ---


@query("suffstats", "o AS (SELECT 1) SELECT chain, view_id, cluster_id, col_id, n, round(sx, 2) AS sx, round(sxx / n, 1) AS mean_sq, k0, k1, k2, k3, k4, round(ssin, 6) AS ssin, round(scos, 6) AS scos FROM (SELECT * REPLACE (" + ", ".join(f"CASE WHEN col_id IN (2,4) THEN CAST(k{k} AS BIGINT) END AS k{k}" for k in range(5)) + ") FROM ss) WHERE col_id <> 0 OR n > 0")
def q_suffstats(spark, sf):
    ss = suffstats(orders_model(spark, sf)).where("n > 0")
    return ss.select(*Q.CLUSTER, "col_id", "n", F.round("sx", 2).alias("sx"), F.round(c("sxx") / c("n"), 1).alias("mean_sq"), *(F.get("counts", F.lit(k)).alias(f"k{k}") for k in range(5)), r6(c("ssin")).alias("ssin"), r6(c("scos")).alias("scos"))


for _type in K.TYPES:
    _cols = {K.CONTINUOUS: "0,1", K.CATEGORICAL: "2", K.BINARY: "3", K.ORDINAL: "4", K.CYCLIC: "5"}[_type]

    @query(f"log_marginal_{_type.lower()}", f"o AS (SELECT 1) SELECT chain, view_id, cluster_id, col_id, round({MARGINAL}, 5) AS log_marginal FROM sc WHERE col_id IN ({_cols})")
    def q_marginal(spark, sf, t=_type):
        return suffstats(orders_model(spark, sf)).where((c("stat_type") == t) & (c("n") > 0)).select(*Q.CLUSTER, "col_id", F.round(K.log_marginal(), 5).alias("log_marginal"))

    @query(f"log_predictive_{_type.lower()}", f"scored AS ({logp_sql('cells')}) SELECT row_id, chain, view_id, cluster_id, col_id, round(logp, 6) AS logp FROM scored WHERE col_id IN ({_cols})")
    def q_predictive(spark, sf, t=_type):
        model = orders_model(spark, sf)
        ids = [s.col_id for s in model.columns if s.stat_type == t]
        return Q.cell_scores(model).where(c("col_id").isin(*ids)).select("row_id", *Q.CLUSTER, "col_id", r6(c("logp")).alias("logp"))


# --- anomaly ---

ANOMALY = f"scored AS ({logp_sql('cells')}), per AS (SELECT row_id, chain, avg(logp) AS m FROM scored GROUP BY ALL), an AS (SELECT b.row_id, nation, coalesce(avg(1/(1+exp(m+2))), 0.5) AS anomaly FROM base b LEFT JOIN per ON per.row_id = b.row_id GROUP BY ALL) "


@query("anomaly_score", ANOMALY + "SELECT row_id, round(anomaly, 6) AS anomaly FROM an")
def q_anomaly(spark, sf):
    return Q.anomaly_scores(orders_model(spark, sf)).select("row_id", r6(c("anomaly")).alias("anomaly"))


@query("anomaly_top", ANOMALY + "SELECT row_id, round(anomaly, 6) AS anomaly FROM an ORDER BY round(anomaly, 9) DESC, row_id LIMIT 50")
def q_anomaly_top(spark, sf):
    scores = Q.anomaly_scores(orders_model(spark, sf)).withColumn("anomaly", F.round("anomaly", 9))
    return Q.top_anomalies(scores, 50).select("row_id", r6(c("anomaly")).alias("anomaly"))


@query("anomaly_ranks", ANOMALY + "SELECT row_id, round((rank() OVER (ORDER BY round(anomaly, 9)) - 1) * 1.0 / count(*) OVER (), 6) AS rank_share FROM an")
def q_anomaly_ranks(spark, sf):
    scores = Q.anomaly_scores(orders_model(spark, sf)).withColumn("anomaly", F.round("anomaly", 9))
    return Q.anomaly_ranks(scores).select("row_id", r6(c("rank_share")).alias("rank_share"))


@query("anomaly_cells", f"scored AS ({logp_sql('cells')}), m AS (SELECT row_id, col_id, avg(logp) AS logp FROM scored GROUP BY ALL) SELECT row_id, col_id, round(logp, 6) AS logp, row_number() OVER (PARTITION BY row_id ORDER BY logp, col_id) AS place FROM m")
def q_anomaly_cells(spark, sf):
    return Q.anomaly_cells(orders_model(spark, sf)).select("row_id", "col_id", r6(c("logp")).alias("logp"), c("place").cast("long").alias("place"))


@query("anomaly_thresholds", ANOMALY + "SELECT round(quantile_cont(anomaly, 0.95), 6) AS by_percentile, round(avg(anomaly) + 2 * stddev_pop(anomaly), 6) AS by_sigma, round(quantile_cont(anomaly, 0.75) + 1.5 * (quantile_cont(anomaly, 0.75) - quantile_cont(anomaly, 0.25)), 6) AS by_iqr FROM an")
def q_thresholds(spark, sf):
    return Q.anomaly_thresholds(Q.anomaly_scores(orders_model(spark, sf))).select(*(r6(c(x)).alias(x) for x in ("by_percentile", "by_sigma", "by_iqr")))


@query("drift_check", ANOMALY + ", s AS (SELECT avg(anomaly) FILTER (nation >= 5) AS base_mean, stddev_pop(anomaly) FILTER (nation >= 5) AS base_sd, avg(anomaly) FILTER (nation < 5) AS batch_mean, count(*) FILTER (nation < 5) AS n_batch FROM an) SELECT round(base_mean, 6) AS base_mean, round(batch_mean, 6) AS batch_mean, n_batch, round((batch_mean - base_mean) / base_sd, 6) AS z, abs((batch_mean - base_mean) / base_sd) > 2 AS drift FROM s")
def q_drift(spark, sf):
    model = orders_model(spark, sf)
    scores = Q.anomaly_scores(model).join(model.rows.select("row_id", "nation"), "row_id")
    return Q.drift_check(scores.where("nation >= 5"), scores.where("nation < 5")).select(r6(c("base_mean")).alias("base_mean"), r6(c("batch_mean")).alias("batch_mean"), "n_batch", r6(c("z")).alias("z"), "drift")


# --- probabilities ---

MIX = f"scored AS ({logp_sql('ac')}), mix AS (SELECT s.query_id, s.chain, s.view_id, s.col_id, ln(sum(exp(lw + logp))) AS lp FROM scored s JOIN weights w ON w.chain = s.chain AND w.view_id = s.view_id AND w.cluster_id = s.cluster_id %s GROUP BY ALL), per AS (SELECT query_id, chain, sum(lp) AS lp FROM mix GROUP BY ALL) SELECT query_id, round(ln(avg(exp(lp))), 6) AS logp FROM per GROUP BY query_id"
JOINT = f"scored AS ({logp_sql('ac')}), byc AS (SELECT query_id, chain, view_id, cluster_id, sum(logp) AS lp FROM scored GROUP BY ALL), mix AS (SELECT s.query_id, s.chain, s.view_id, ln(sum(exp(lw + lp))) AS lp FROM byc s JOIN weights w ON w.chain = s.chain AND w.view_id = s.view_id AND w.cluster_id = s.cluster_id %s GROUP BY ALL), per AS (SELECT query_id, chain, sum(lp) AS lp FROM mix GROUP BY ALL) SELECT query_id, round(ln(avg(exp(lp))), 6) AS logp FROM per GROUP BY query_id"
SAME = "AND w.query_id = s.query_id"


def _logp(df: DataFrame) -> DataFrame:
    return df.select("query_id", r6(c("logp")).alias("logp"))


@query("predictive_probability", ASKED_SQL + WEIGHTS + ASKED_CELLS + MIX % "")
def q_probability(spark, sf):
    return _logp(Q.predictive_probability(orders_model(spark, sf), asked(spark, ASKED)))


@query("predictive_probability_conditioned", ASKED_SQL + WEIGHTED + ASKED_CELLS + MIX % SAME)
def q_probability_given(spark, sf):
    return _logp(Q.predictive_probability(orders_model(spark, sf), asked(spark, ASKED), asked(spark, CONDITIONS)))


@query("joint_probability", ASKED_SQL + WEIGHTS + ASKED_CELLS + JOINT % "")
def q_joint(spark, sf):
    return _logp(Q.joint_probability(orders_model(spark, sf), asked(spark, ASKED)))


@query("joint_probability_conditioned", ASKED_SQL + WEIGHTED + ASKED_CELLS + JOINT % SAME)
def q_joint_given(spark, sf):
    return _logp(Q.joint_probability(orders_model(spark, sf), asked(spark, ASKED), asked(spark, CONDITIONS)))


@query("predictive_probability_rows", f"rc AS (SELECT p.row_id, p.chain, p.view_id, p.cluster_id, cp.col_id, CASE cp.col_id WHEN 0 THEN 150000.0 WHEN 3 THEN 1.0 END AS x FROM parts p JOIN cp ON cp.chain = p.chain AND cp.view_id = p.view_id AND cp.col_id IN (0, 3)), scored AS ({logp_sql('rc')}), per AS (SELECT row_id, chain, sum(logp) AS lp FROM scored GROUP BY ALL) SELECT row_id AS query_id, round(ln(avg(exp(lp))), 6) AS logp FROM per GROUP BY row_id")
def q_probability_rows(spark, sf):
    model = orders_model(spark, sf)
    cells = model.rows.select(c("row_id").alias("query_id"), "row_id", F.inline(F.array(*(F.struct(F.lit(i).alias("col_id"), F.lit(v).alias("value")) for i, v in ((0, 150000.0), (3, 1.0))))))
    return _logp(Q.row_predictive_probability(model, cells))


@query("cdf_discrete", WEIGHTS + "m AS (SELECT l.chain, l.col_id, l.level, sum(exp(lw + lp)) AS p FROM lv l JOIN weights w ON w.chain = l.chain AND w.view_id = l.view_id AND w.cluster_id = l.cluster_id GROUP BY ALL), r AS (SELECT chain, col_id, level, least(1, sum(p) OVER (PARTITION BY chain, col_id ORDER BY level)) AS cdf FROM m) SELECT col_id, CAST(level AS INT) AS level, round(avg(cdf), 6) AS cdf FROM r GROUP BY ALL")
def q_cdf(spark, sf):
    return Q.discrete_cdf(orders_model(spark, sf)).select("col_id", "level", r6(c("cdf")).alias("cdf"))


ROW_LEVELS = "rl AS (SELECT p.row_id, l.col_id, l.level, ln(avg(exp(lp))) AS logp FROM parts p JOIN lv l ON l.chain = p.chain AND l.view_id = p.view_id AND l.cluster_id = p.cluster_id GROUP BY ALL) "


@query("classify", ROW_LEVELS + "SELECT row_id, CAST(arg_max(level, struct_pack(a := round(logp, 9), b := -level)) AS INT) AS level, round(max(logp), 6) AS logp FROM rl WHERE col_id = 4 GROUP BY row_id")
def q_classify(spark, sf):
    return Q.classify(orders_model(spark, sf), 4).select("row_id", "level", r6(c("logp")).alias("logp"))


@query("binary_scores", ROW_LEVELS + "SELECT row_id, col_id, round(max(CASE WHEN level = 1 THEN exp(logp) END) / sum(exp(logp)), 6) AS p1 FROM rl WHERE col_id = 3 GROUP BY ALL")
def q_binary(spark, sf):
    return Q.binary_scores(orders_model(spark, sf), [3]).select("row_id", "col_id", r6(c("p1")).alias("p1"))


@query("impute_discrete", ROW_LEVELS + "SELECT row_id, CAST(arg_max(level, struct_pack(a := round(logp, 9), b := -level)) AS INT) AS value, round(exp(max(logp)), 6) AS confidence FROM rl WHERE col_id = 2 GROUP BY row_id")
def q_impute(spark, sf):
    return Q.impute_discrete(orders_model(spark, sf), 2).select("row_id", "value", r6(c("confidence")).alias("confidence"))


@query("mean_log_likelihood", f"scored AS ({logp_sql('cells')}) SELECT col_id, round(avg(logp), 6) AS mean_logp, count(*) AS n FROM scored GROUP BY col_id")
def q_mean_ll(spark, sf):
    model = orders_model(spark, sf)
    held = model.rows.select("row_id", F.inline(F.array(*(F.struct(F.lit(s.col_id).alias("col_id"), c(s.name).alias("value")) for s in model.columns))))
    return Q.mean_log_likelihood(model, held).select("col_id", r6(c("mean_logp")).alias("mean_logp"), "n")


# --- structure ---

CRP = "count(*) * ln(1.0) + sum(lgamma(n)) - lgamma(sum(n) + 1.0) + lgamma(1.0)"


@query("log_joint", f"m AS (SELECT chain, sum({MARGINAL}) AS marginal FROM sc GROUP BY chain), r AS (SELECT chain, sum(v - 1) AS rows FROM (SELECT chain, view_id, {CRP} AS v FROM (SELECT chain, view_id, CAST(n_rows AS DOUBLE) AS n FROM sizes) GROUP BY ALL) GROUP BY chain), k AS (SELECT chain, {CRP} - 1 AS cols FROM (SELECT chain, view_id, CAST(count(*) AS DOUBLE) AS n FROM cp GROUP BY ALL) GROUP BY chain) SELECT m.chain, round(marginal + rows + cols, 3) AS log_joint FROM m JOIN r ON r.chain = m.chain JOIN k ON k.chain = m.chain")
def q_log_joint(spark, sf):
    return Q.log_joint(orders_model(spark, sf)).select("chain", F.round("log_joint", 3).alias("log_joint"))


@query("structure", "s AS (SELECT chain, view_id, count(*) AS n_clusters, CAST(sum(n_rows) AS BIGINT) AS n_rows, max(n_rows) AS largest FROM sizes GROUP BY ALL), k AS (SELECT chain, view_id, string_agg(name, ',' ORDER BY cp.col_id) AS columns FROM cp JOIN names ON names.col_id = cp.col_id GROUP BY ALL) SELECT k.chain, k.view_id, k.columns, n_clusters, n_rows, largest, CAST(1.0 AS DOUBLE) AS alpha FROM k JOIN s ON s.chain = k.chain AND s.view_id = k.view_id")
def q_structure(spark, sf):
    return Q.structure(orders_model(spark, sf))


DEP = "dep AS (SELECT a.col_id AS col_i, b.col_id AS col_j, avg(CAST(a.view_id = b.view_id AS DOUBLE)) AS dependence FROM cp a JOIN cp b ON a.chain = b.chain AND a.col_id < b.col_id GROUP BY ALL)"


@query("dependence", DEP + " SELECT * FROM dep")
def q_dependence(spark, sf):
    return Q.dependence(orders_model(spark, sf))


@query("top_dependence", DEP + " SELECT * FROM dep ORDER BY dependence DESC, col_i, col_j LIMIT 5")
def q_top_dependence(spark, sf):
    return Q.top_dependence(orders_model(spark, sf), 5)


@query("column_typicality", DEP + ", two AS (SELECT col_i AS col_id, dependence AS d FROM dep UNION ALL SELECT col_j, dependence FROM dep), p AS (SELECT col_id, d / sum(d) OVER (PARTITION BY col_id) AS p FROM two) SELECT names.col_id, name, round(1 - sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(5.0), 6) AS typicality FROM p JOIN names ON names.col_id = p.col_id GROUP BY ALL")
def q_column_typicality(spark, sf):
    return Q.column_typicality(orders_model(spark, sf)).select("col_id", "name", r6(c("typicality")).alias("typicality"))


@query("row_typicality", "t AS (SELECT chain, view_id, cluster_id, sum(n_rows) OVER (PARTITION BY chain, view_id ORDER BY n_rows RANGE UNBOUNDED PRECEDING) * 1.0 / sum(n_rows) OVER (PARTITION BY chain, view_id) AS t FROM sizes), e AS (SELECT row_id, p.chain, avg(t) AS t FROM parts p JOIN t ON t.chain = p.chain AND t.view_id = p.view_id AND t.cluster_id = p.cluster_id GROUP BY ALL) SELECT row_id, round(avg(t), 6) AS typicality FROM e GROUP BY row_id")
def q_row_typicality(spark, sf):
    return Q.row_typicality(orders_model(spark, sf)).select("row_id", r6(c("typicality")).alias("typicality"))


SIM = "pairs AS (SELECT row_id AS row_a, row_id + 32 AS row_b FROM base), s AS (SELECT row_a, row_b, a.chain, avg(CAST(a.cluster_id = b.cluster_id AS DOUBLE)) AS s FROM pairs JOIN parts a ON a.row_id = row_a JOIN parts b ON b.row_id = row_b AND b.chain = a.chain AND b.view_id = a.view_id %s GROUP BY ALL), m AS (SELECT row_a, row_b, avg(s) AS s FROM s GROUP BY ALL) SELECT pairs.row_a, pairs.row_b, round(coalesce(s, 0), 6) AS similarity FROM pairs LEFT JOIN m ON m.row_a = pairs.row_a AND m.row_b = pairs.row_b"


@query("row_similarity", SIM % "")
def q_similarity(spark, sf, targets=None):
    model = orders_model(spark, sf)
    pairs = model.rows.select(c("row_id").alias("row_a"), (c("row_id") + 32).alias("row_b"))
    return Q.row_similarity(model, pairs, targets).select("row_a", "row_b", r6(c("similarity")).alias("similarity"))


@query("row_similarity_targets", SIM % "AND (a.chain, a.view_id) IN (SELECT (chain, view_id) FROM cp WHERE col_id IN (3, 5))")
def q_similarity_targets(spark, sf):
    return q_similarity(spark, sf, [3, 5])


@query("segment_profile", "p AS (SELECT ss.*, stat_type, name, sx/n AS mean, sqrt(greatest(sxx/n - (sx/n)*(sx/n), 0)) AS sd, sum(n) OVER w AS an, sum(sx) OVER w AS asx, sum(sxx) OVER w AS aq, greatest(k0,k1,k2,k3,k4) AS kk FROM ss JOIN names ON names.col_id = ss.col_id WINDOW w AS (PARTITION BY chain, ss.col_id)) SELECT chain, view_id, cluster_id, col_id, name, n, CASE WHEN col_id IN (0,1,3,4) THEN round(mean, 5) END AS mean, CASE WHEN col_id IN (0,1) THEN round(sd, 4) END AS sd, CASE WHEN col_id IN (0,1) THEN round((mean - asx/an) / sqrt(aq/an - (asx/an)*(asx/an)), 6) END AS z, CASE WHEN col_id IN (2,4) THEN CASE kk WHEN k0 THEN 0 WHEN k1 THEN 1 WHEN k2 THEN 2 WHEN k3 THEN 3 ELSE 4 END END AS mode, CASE WHEN col_id IN (2,4) THEN round(kk * 1.0 / n, 6) END AS mode_share, CASE WHEN col_id = 5 THEN round(CASE WHEN atan2(ssin, scos) < 0 THEN atan2(ssin, scos) + 2*pi() ELSE atan2(ssin, scos) END, 6) END AS circular_mean, CASE WHEN col_id = 5 THEN round(sqrt(-2*ln(sqrt(ssin*ssin+scos*scos)/n)), 6) END AS circular_sd FROM p")
def q_segments(spark, sf):
    p = Q.segment_profile(orders_model(spark, sf))
    digits = {"mean": 5, "sd": 4, "z": 6, "mode_share": 6, "circular_mean": 6, "circular_sd": 6}
    return p.drop("stat_type").select(*(F.round(x, digits[x]).alias(x) if x in digits else c(x) for x in p.columns if x != "stat_type"))


@query("fingerprint_similarity", "e AS (SELECT nation, p.chain, p.view_id, p.cluster_id, count(*) AS k FROM parts p JOIN base b ON b.row_id = p.row_id GROUP BY ALL), sh AS (SELECT nation, chain, view_id, cluster_id, k * 1.0 / sum(k) OVER (PARTITION BY nation, chain, view_id) AS p FROM e), one AS (SELECT nation, view_id, cluster_id, (sum(p) + CASE WHEN view_id = 1 THEN 1.0 / 3 ELSE 0 END) / 4 AS p FROM sh GROUP BY nation, view_id, cluster_id), ns AS (SELECT DISTINCT nation FROM base), places AS (SELECT view_id, unnest(range(CASE WHEN view_id = 0 THEN 6 ELSE 3 END)) AS cluster_id FROM (VALUES (0), (1)) t(view_id)), f AS (SELECT nation, g.view_id, g.cluster_id, coalesce(p, CASE WHEN g.view_id = 1 THEN 1.0 / 12 ELSE 0 END) AS p FROM ns CROSS JOIN places g LEFT JOIN one USING (nation, view_id, cluster_id)) SELECT a.nation AS entity_a, b.nation AS entity_b, round(sum(a.p * b.p) / (sqrt(sum(a.p * a.p)) * sqrt(sum(b.p * b.p))), 6) AS similarity FROM f a JOIN f b ON b.nation = a.nation + 1 AND b.view_id = a.view_id AND b.cluster_id = a.cluster_id GROUP BY ALL")
def q_fingerprint(spark, sf):
    model = orders_model(spark, sf)
    prints = Q.fingerprints(model, model.rows.select("row_id", c("nation").alias("entity")))
    return Q.fingerprint_similarity(prints, prints.select(c("entity").alias("entity_a"), (c("entity") + 1).alias("entity_b"))).select("entity_a", "entity_b", r6(c("similarity")).alias("similarity"))


PAIR = "j AS (SELECT a.chain, a.level AS a, b.level AS b, sum(exp(lw + a.lp + b.lp)) AS p FROM lv a JOIN lv b ON b.chain = a.chain AND b.view_id = a.view_id AND b.cluster_id = a.cluster_id AND a.col_id = %d AND b.col_id = %d JOIN weights w ON w.chain = a.chain AND w.view_id = a.view_id AND w.cluster_id = a.cluster_id GROUP BY ALL), jj AS (SELECT *, sum(p) OVER (PARTITION BY chain, a) AS pa, sum(p) OVER (PARTITION BY chain, b) AS pb FROM j), "


@query("mutual_information_discrete", WEIGHTS + PAIR % (3, 4) + "m AS (SELECT chain, greatest(0, sum(p * ln(p / (pa * pb)))) AS mi FROM jj GROUP BY chain), t AS (SELECT avg(coalesce(mi, 0)) AS mi FROM (SELECT DISTINCT chain FROM cp) c LEFT JOIN m ON m.chain = c.chain) SELECT 3 AS col_i, 4 AS col_j, round(mi, 8) AS mi, round(sqrt(1 - exp(-2 * mi)), 6) AS linfoot FROM t")
def q_mi(spark, sf):
    return Q.mutual_information_discrete(orders_model(spark, sf), 3, 4).select("col_i", "col_j", F.round("mi", 8).alias("mi"), r6(c("linfoot")).alias("linfoot"))


@query("conditional_entropy_discrete", WEIGHTS + PAIR % (2, 3) + "h AS (SELECT chain, -sum(p * ln(p / pb)) AS h FROM jj GROUP BY chain), l AS (SELECT l.chain, level, sum(exp(lw + lp)) AS p FROM lv l JOIN weights w ON w.chain = l.chain AND w.view_id = l.view_id AND w.cluster_id = l.cluster_id WHERE col_id = 2 GROUP BY ALL), mm AS (SELECT chain, -sum(p * ln(p)) AS m FROM l GROUP BY chain) SELECT 2 AS target, 3 AS given_col, round(avg(coalesce(h, m)), 6) AS entropy FROM mm LEFT JOIN h ON h.chain = mm.chain")
def q_entropy(spark, sf):
    return Q.conditional_entropy_discrete(orders_model(spark, sf), 2, 3).select("target", "given_col", r6(c("entropy")).alias("entropy"))


# --- diagnostics, constraints ---


@query("adjusted_rand_index", "p AS (SELECT a.cluster_id AS a, b.cluster_id AS b FROM parts a JOIN parts b ON a.row_id = b.row_id AND a.chain = 3 AND a.view_id = 1 AND b.chain = 0 AND b.view_id = 1), n AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY ALL), t AS (SELECT (SELECT sum(n*(n-1)/2) FROM n) AS s, (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) AS n FROM n GROUP BY a)) AS sa, (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) AS n FROM n GROUP BY b)) AS sb, (SELECT sum(n)*(sum(n)-1)/2 FROM n) AS al) SELECT round((s - sa*sb/al) / ((sa+sb)/2 - sa*sb/al), 6) AS ari FROM t")
def q_ari(spark, sf):
    model = orders_model(spark, sf)
    label = lambda ch, v: F.filter("parts", lambda p: (p["chain"] == ch) & (p["view_id"] == v))[0]["cluster_id"]
    return diagnostics.adjusted_rand_index(model.rows.select(label(3, 1).alias("a"), label(0, 1).alias("b"))).select(r6(c("ari")).alias("ari"))


TRACE = "WITH t AS (SELECT CAST(o_custkey % 4 AS INT) AS chain, CAST(o_orderkey AS BIGINT) AS sweep, o_totalprice AS value FROM orders WHERE o_custkey % 4 < 4), "


def order_trace(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select((c("o_custkey") % 4).cast("int").alias("chain"), c("o_orderkey").cast("long").alias("sweep"), F.lit("price").alias("metric"), c("o_totalprice").cast("double").alias("value"))


@query("rhat", TRACE + "p AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY sweep) - 1 AS i, count(*) OVER (PARTITION BY chain) AS k FROM t), h AS (SELECT *, (SELECT min(k) // 2 FROM p) AS half FROM p), g AS (SELECT chain, i >= half AS s, half, avg(value) AS m, var_samp(value) AS v FROM h WHERE i < 2 * half GROUP BY ALL), w AS (SELECT half, avg(v) AS w, var_samp(m) * half AS b FROM g GROUP BY half) SELECT 'price' AS metric, round(greatest(1.0, sqrt(((half - 1.0) / half * w + b / half) / w)), 6) AS rhat FROM w")
def q_rhat(spark, sf):
    return diagnostics.gelman_rubin(order_trace(spark, sf)).select("metric", r6(c("rhat")).alias("rhat"))


#: No SQL: all lags of whole chains are their length squared; tests hold it against brute force.
@query("ess")
def q_ess(spark, sf):
    return diagnostics.effective_sample_size(order_trace(spark, sf)).select("metric", F.round("ess", 4).alias("ess"))


@query("bma_intervals", f"scored AS ({logp_sql('cells')}), m AS (SELECT row_id, chain, avg(logp) AS m FROM scored GROUP BY ALL) SELECT row_id, round(avg(m), 6) AS mean, round(least(avg(m) - 1.96*stddev_pop(m), avg(m - 1)), 6) AS lo, round(greatest(avg(m) + 1.96*stddev_pop(m), avg(m + 1)), 6) AS hi FROM m GROUP BY row_id")
def q_bma(spark, sf):
    per = Q.cell_scores(orders_model(spark, sf)).groupBy("row_id", "chain").agg(F.avg("logp").alias("mean")).withColumn("lo", c("mean") - 1).withColumn("hi", c("mean") + 1)
    return diagnostics.bma_intervals(per).select("row_id", *(r6(c(x)).alias(x) for x in ("mean", "lo", "hi")))


@query("column_constraints", "k(col_a, col_b, dependent) AS (VALUES (0, 1, true), (0, 3, false), (4, 5, true)) SELECT a.chain, col_a, col_b, dependent, (a.view_id = b.view_id) = dependent AS satisfied FROM k JOIN cp a ON a.col_id = col_a JOIN cp b ON b.col_id = col_b AND b.chain = a.chain")
def q_column_constraints(spark, sf):
    return constraints.check_column_constraints(orders_model(spark, sf), [(0, 1, True), (0, 3, False), (4, 5, True)])


@query("row_constraints", "k AS (SELECT row_id AS row_a, row_id + 12 AS row_b, row_id % 2 = 0 AS dependent FROM base) SELECT row_a, row_b, dependent, a.chain, bool_and((a.cluster_id = b.cluster_id) = dependent) AS satisfied FROM k JOIN parts a ON a.row_id = row_a JOIN parts b ON b.row_id = row_b AND b.chain = a.chain AND b.view_id = a.view_id GROUP BY ALL")
def q_row_constraints(spark, sf):
    model = orders_model(spark, sf)
    pairs = model.rows.select(c("row_id").alias("row_a"), (c("row_id") + 12).alias("row_b"), (c("row_id") % 2 == 0).alias("dependent"))
    return constraints.check_row_constraints(model, pairs)


@query("validate_model", "o AS (SELECT 1) SELECT 'x' AS problem, CAST(1 AS BIGINT) AS count WHERE false")
def q_validate(spark, sf):
    return constraints.validate(orders_model(spark, sf))


@query("best_chain", SQL["log_joint"].replace("SELECT m.chain, round(marginal + rows + cols, 3) AS log_joint", "SELECT arg_max(m.chain, marginal + rows + cols) AS chain, round(max(marginal + rows + cols), 3) AS log_joint"))
def q_best(spark, sf):
    return diagnostics.best_chain(Q.log_joint(orders_model(spark, sf))).select("chain", F.round("log_joint", 3).alias("log_joint"))


# --- ingest ---

TYPED = {"part": ("p_size", "p_retailprice"), "lineitem": ("l_linenumber", "l_discount"), "customer": ("c_nationkey",), "labels": ("quality",)}
_typed = lambda t, n: f"SELECT '{n}' AS name, count(DISTINCT x) AS u, count(x) AS n, min(x) AS lo, max(x) AS hi, bool_and(abs(x - round_even(x, 0)) <= 1e-8 + 1e-5 * abs(round_even(x, 0))) AS w FROM (SELECT CAST({n} AS DOUBLE) AS x FROM {t})"


@query("guess_column_types", "WITH t AS (" + " UNION ALL ".join(_typed(t, n) for t, ns in TYPED.items() for n in ns) + ") SELECT name, CASE WHEN n = 0 THEN 'CONTINUOUS' WHEN u <= 2 AND lo IN (0,1) AND hi IN (0,1) THEN 'BINARY' WHEN w AND (u <= 20 OR u * 1.0 / n < 0.02) THEN 'CATEGORICAL' ELSE 'CONTINUOUS' END AS stat_type, u AS n_unique, n FROM t")
def q_types(spark, sf):
    found = [ingest.guess_column_types(spark.read.parquet(f"{sf}/{t}.parquet"), ns) for t, ns in TYPED.items()]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


@query("column_codes", "WITH t AS (SELECT DISTINCT c_mktsegment AS value FROM customer) SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM t")
def q_codes(spark, sf):
    return ingest.column_codes(spark.read.parquet(f"{sf}/customer.parquet"), "c_mktsegment")


@query("encode_frequency", "WITH k AS (SELECT c_nationkey AS v, count(*) AS n FROM customer GROUP BY ALL), f AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS code FROM k WHERE n >= 60) SELECT c_custkey, CAST(coalesce(code, (SELECT count(*) FROM f)) AS INT) AS code FROM customer LEFT JOIN f ON v = c_nationkey")
def q_frequency(spark, sf):
    return ingest.encode_frequency(spark.read.parquet(f"{sf}/customer.parquet"), "c_nationkey", "code", 60).select("c_custkey", "code")


@query("discretize", "WITH t AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS x, min(CAST(o_totalprice AS DOUBLE)) OVER () AS lo, max(CAST(o_totalprice AS DOUBLE)) OVER () AS hi FROM orders) SELECT o_orderkey, CAST(least(floor((x - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin FROM t")
def q_discretize(spark, sf):
    return ingest.discretize(spark.read.parquet(f"{sf}/orders.parquet"), "o_totalprice", "bin").select("o_orderkey", "bin")


@query("cyclic_and_dates", "SELECT event_id, CAST(hour(ts) AS INT) AS ts_hour, CAST(isodow(ts) - 1 AS INT) AS ts_weekday, CAST(month(ts) AS INT) AS ts_month, round((hour(ts) - 3 + 24) % 24 / 24.0 * 2 * pi(), 6) AS angle FROM events")
def q_dates(spark, sf):
    df = ingest.datetime_parts(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts"), "ts")
    return df.select("event_id", "ts_hour", "ts_weekday", "ts_month", r6(ingest.cyclic(c("ts_hour").cast("double"), 24.0, 3.0)).alias("angle"))


@query("profile", "o AS (SELECT 1), u AS (SELECT 'total' AS name, total AS x FROM base UNION ALL SELECT 'priority', priority FROM base UNION ALL SELECT 'bal', bal FROM base), s AS (SELECT name, count(*) AS n_rows, count(x) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_pop(x) AS sd, median(x) AS median, count(DISTINCT x) AS n_unique, count(*) FILTER (x = 0) AS zeros FROM u GROUP BY name) SELECT s.name, n_rows, n, lo, hi, round(mean, 4) AS mean, round(sd, 4) AS sd, round(median, 4) AS median, n_unique, zeros, count(*) FILTER (abs(u.x - mean) > 3 * sd) AS outliers, round(1 - n * 1.0 / n_rows, 6) AS missing, n_unique <= 1 AS constant FROM s JOIN u ON u.name = s.name GROUP BY ALL")
def q_profile(spark, sf):
    p = ingest.profile(orders_rows(spark, sf), ["total", "priority", "bal"])
    return p.drop("skew").withColumns({x: F.round(x, 4) for x in ("mean", "sd", "median")}).withColumn("missing", r6(c("missing")))


@query("zscore", "o AS (SELECT 1) SELECT row_id, round((total - avg(total) OVER ()) / stddev_pop(total) OVER (), 6) AS total FROM base")
def q_zscore(spark, sf):
    return ingest.zscore(orders_rows(spark, sf).select("row_id", "total"), ["total"]).select("row_id", r6(c("total")).alias("total"))


@query("remaining_life", "SELECT event_id, least(max(event_id) OVER (PARTITION BY user_id) - event_id, 125) AS rul FROM events")
def q_life(spark, sf):
    return ingest.remaining_life(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id"), "user_id", "event_id", 125).select("event_id", c("rul").cast("long").alias("rul"))


@query("latest_by_key", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def q_latest(spark, sf):
    return ingest.latest(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "event_id", ["value"])


@query("events_suffstats", "WITH x AS (SELECT CAST(user_id % 4 AS INT) AS cluster_id, value, hour(ts) * 2 * pi() / 24 AS hour FROM events) SELECT cluster_id, count(value) AS n, round(sum(value), 3) AS sx, round(sum(sin(hour)), 6) AS ssin, round(sum(cos(hour)), 6) AS scos FROM x GROUP BY cluster_id")
def q_events(spark, sf):
    from weftline.plans.model import PARTS, ColumnSpec, given

    rows = spark.read.parquet(f"{sf}/events.parquet").select(c("event_id").cast("long").alias("row_id"), c("value").cast("double").alias("value"), (F.hour("ts") * (2 * math.pi / 24)).alias("hour"), F.array(F.expr("struct(0 as chain, 0 as view_id, cast(user_id % 4 as int) as cluster_id)")).cast(PARTS).alias("parts"))
    ss = suffstats(given(rows, [ColumnSpec(0, "value", K.CONTINUOUS), ColumnSpec(1, "hour", K.CYCLIC)], {(0, 0): 0, (0, 1): 0}))
    pick = lambda col, x: F.max(F.when(c("col_id") == col, c(x)))
    return ss.groupBy("cluster_id").agg(pick(0, "n").alias("n"), F.round(pick(0, "sx"), 3).alias("sx"), r6(pick(1, "ssin")).alias("ssin"), r6(pick(1, "scos")).alias("scos"))


@query("train_holdout", "SELECT o_orderkey, CAST('0x' || substr(md5('7|' || CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.8 AS train FROM orders")
def q_split(spark, sf):
    return ingest.split(spark.read.parquet(f"{sf}/orders.parquet"), ["o_custkey"], 0.8, 7).select("o_orderkey", "train")


@query("set_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q_difference(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(c("o_custkey").alias("c_custkey"))
    return ingest.set_difference(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey"), orders, ["c_custkey"])


@query("regression_metrics", "WITH t AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) * 1500 AS g FROM lineitem) SELECT round(avg(abs(g - y)), 4) AS mae, round(sqrt(avg((g - y) * (g - y))), 4) AS rmse, round(avg(g - y), 4) AS bias, round(1 - sum((g - y) * (g - y)) / (var_pop(y) * count(y)), 6) AS r2, round(corr(y, g), 6) AS pearson, round(sqrt(avg((g - y) * (g - y))) / stddev_pop(y), 6) AS nrmse, round(avg(CASE WHEN y BETWEEN g - 9000 AND g + 9000 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(18000.0), 4) AS width FROM t")
def q_regression(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select(c("l_extendedprice").cast("double").alias("y"), (c("l_quantity").cast("double") * 1500).alias("g"))
    got = diagnostics.regression_metrics(t.withColumns({"lo": c("g") - 9000, "hi": c("g") + 9000}), "y", "g", "lo", "hi")
    return got.select(*(F.round(x, 4 if x in ("mae", "rmse", "bias", "width") else 6).alias(x) for x in got.columns))


ORDER_NAMES = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("informative_columns", "WITH t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(DISTINCT {n}) AS d, count(*) AS n FROM orders" for n in ORDER_NAMES) + ") SELECT name FROM t WHERE 1 < d AND d < n")
def q_informative(spark, sf):
    return spark.createDataFrame([(n,) for n in ingest.drop_uninformative(spark.read.parquet(f"{sf}/orders.parquet"), ORDER_NAMES)], "name string")


@query("column_coverage", "o AS (SELECT 1), t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count({n}) * 1.0 / count(*) AS share FROM base" for n in ("total", "bal", "priority")) + ") SELECT name FROM t WHERE share >= 0.88")
def q_coverage(spark, sf):
    return spark.createDataFrame([(n,) for n in ingest.coverage(orders_rows(spark, sf), ["total", "bal", "priority"], 0.88)], "name string")


@query("missing_correlation", "o AS (SELECT 1), m AS (SELECT CASE WHEN total IS NULL THEN 1.0 ELSE 0.0 END AS a, CASE WHEN bal IS NULL THEN 1.0 ELSE 0.0 END AS b, CASE WHEN priority IS NULL THEN 1.0 ELSE 0.0 END AS p FROM base), t AS (SELECT 'total' AS a, 'bal' AS b, corr(a, b) AS r FROM m UNION ALL SELECT 'total', 'priority', corr(a, p) FROM m UNION ALL SELECT 'bal', 'priority', corr(b, p) FROM m) SELECT a, b, round(r, 6) AS r FROM t WHERE abs(r) > 0.05")
def q_missing(spark, sf):
    return ingest.missing_correlation(orders_rows(spark, sf), ["total", "bal", "priority"], 0.05).select("a", "b", r6(c("r")).alias("r"))


@query("top_values", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, value LIMIT 3")
def q_top_values(spark, sf):
    return ingest.top_values(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderpriority", 3)


@query("duplicate_rows", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)")
def q_duplicates(spark, sf):
    return ingest.duplicate_rows(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_linenumber"))


@query("regimes", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY round(CAST(c_acctbal AS DOUBLE) / 1000, 0), c_nationkey) - 1 AS INT) AS regime FROM customer")
def q_regimes(spark, sf):
    t = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (c("c_acctbal").cast("double") / 1000).alias("k"), "c_nationkey")
    return ingest.regimes(t, ["k", "c_nationkey"]).select("c_custkey", "regime")


@query("row_ari", SQL["adjusted_rand_index"].replace("SELECT a.cluster_id AS a, b.cluster_id AS b FROM parts a JOIN parts b ON a.row_id = b.row_id AND a.chain = 3 AND a.view_id = 1 AND b.chain = 0 AND b.view_id = 1", "SELECT a.cluster_id AS a, b.nation AS b FROM parts a JOIN base b ON a.row_id = b.row_id AND a.chain = 1 AND a.view_id = 0"))
def q_row_ari(spark, sf):
    model = orders_model(spark, sf)
    return diagnostics.row_ari(model, model.rows.select("row_id", c("nation").alias("label")), 1, 0).select(r6(c("ari")).alias("ari"))


assert set(VIEWS.values()) == {0, 1}
