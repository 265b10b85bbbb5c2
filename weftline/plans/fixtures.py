"""Models over given tables with given partitions, deterministic and expressible in SQL, and that SQL.

Orders joined with customers have columns of all five types; four chains partition them by expressions of the row. Cells
go missing by rules on the key, with some rows missing altogether.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import components as K
from weftline.operators.ingest import encode_sorted
from weftline.plans.model import PARTS, ColumnSpec, Model, given

SPECS = [
    ColumnSpec(0, "total", K.CONTINUOUS), ColumnSpec(1, "bal", K.CONTINUOUS), ColumnSpec(2, "segment", K.CATEGORICAL, 5),
    ColumnSpec(3, "is_open", K.BINARY), ColumnSpec(4, "priority", K.ORDINAL, 5), ColumnSpec(5, "month", K.CYCLIC),
]
#: (chain, view) -> its columns and the expression of the cluster, the same text in both engines.
GIVEN = {
    (0, 0): ((0, 1, 2), "o_custkey % 4"), (0, 1): ((3, 4, 5), "o_orderkey % 3"), (1, 0): ((0, 1, 2, 3), "c_nationkey % 5"), (1, 1): ((4, 5), "o_orderkey % 2"), (2, 0): ((0, 1, 2, 3, 4, 5), "o_orderkey % 6"),
    (3, 0): ((0, 1, 2), "CASE WHEN o_totalprice > 400000 THEN 2 WHEN o_totalprice > 200000 THEN 1 ELSE 0 END"), (3, 1): ((3, 4, 5), "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"),
}
VIEWS = {(chain, col): view for (chain, view), (cols, _) in GIVEN.items() for col in cols}


def orders_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate")
    customers = encode_sorted(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_mktsegment", "segment_code")
    both = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    seen = F.col("o_orderkey") % 1000 != 999
    cell = lambda x, when=None: F.when(seen if when is None else seen & when, x.cast("double"))
    parts = F.array(*(F.expr(f"struct({ch} as chain, {v} as view_id, cast({e} as int) as cluster_id)") for (ch, v), (_, e) in GIVEN.items())).cast(PARTS)
    return both.select(
        F.col("o_orderkey").cast("long").alias("row_id"), cell(F.col("o_totalprice"), F.col("o_orderkey") % 10 != 3).alias("total"), cell(F.col("c_acctbal")).alias("bal"), cell(F.col("segment_code")).alias("segment"),
        cell((F.col("o_orderstatus") == "O").cast("int")).alias("is_open"), cell(F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.col("o_orderkey") % 7 != 2).alias("priority"),
        cell((F.month("o_orderdate") - 1) * (2 * math.pi / 12)).alias("month"), parts.alias("parts"), F.col("o_custkey").cast("long").alias("entity"), F.col("c_nationkey").cast("int").alias("nation"),
    )


def orders_model(spark: SparkSession, sf_dir: str) -> Model:
    return given(orders_rows(spark, sf_dir), SPECS, VIEWS)


def _logistic(x: str) -> str:
    return f"(1/(1+exp(-({x}))))"


CUTS = [-2 + 4 * i / 3 for i in range(4)]


def _level(m: str, k: int) -> str:
    hi = "1.0" if k == 4 else _logistic(f"{CUTS[k]!r} - {m}")
    lo = "0.0" if k == 0 else _logistic(f"{CUTS[k - 1]!r} - {m}")
    return f"greatest({hi} - {lo}, 1e-30)"


def _i0(x: str) -> str:
    from weftline.functions.math import I0_SMALL

    poly = "+".join(f"{a!r}*pow({x}/3.75,{2 * i})" for i, a in enumerate(I0_SMALL))
    return f"(CASE WHEN {x} < 3.75 THEN ln({poly}) ELSE {x} - 0.5*ln(2*pi()*{x}) END)"


_PARTS = " UNION ALL ".join(f"SELECT row_id, {ch} AS chain, {v} AS view_id, CAST({e} AS INT) AS cluster_id FROM raw" for (ch, v), (_, e) in GIVEN.items())
_CP = ", ".join(f"({ch},{col},{v})" for (ch, col), v in VIEWS.items())
_NAMES = ", ".join(f"({s.col_id},'{s.name}','{s.stat_type}')" for s in SPECS)

#: Common table expressions that all SQL below starts from.
BASE = f"""
WITH seg AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)),
raw AS (SELECT o.*, c.c_nationkey, c.c_acctbal, seg.code, CAST(o_orderkey AS BIGINT) AS row_id, o_orderkey % 1000 <> 999 AS seen FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN seg ON seg.c_mktsegment = c.c_mktsegment),
base AS (SELECT row_id, CASE WHEN seen AND o_orderkey % 10 <> 3 THEN CAST(o_totalprice AS DOUBLE) END AS total, CASE WHEN seen THEN CAST(c_acctbal AS DOUBLE) END AS bal, CASE WHEN seen THEN CAST(code AS DOUBLE) END AS segment,
  CASE WHEN seen THEN CAST(o_orderstatus = 'O' AS DOUBLE) END AS is_open, CASE WHEN seen AND o_orderkey % 7 <> 2 THEN CAST(substr(o_orderpriority,1,1) AS DOUBLE) - 1 END AS priority, CASE WHEN seen THEN (month(o_orderdate)-1)*(2*pi()/12) END AS month,
  CAST(o_custkey AS BIGINT) AS entity, CAST(c_nationkey AS INT) AS nation FROM raw),
names(col_id, name, stat_type) AS (VALUES {_NAMES}),
parts AS ({_PARTS}),
cp(chain, col_id, view_id) AS (VALUES {_CP}),
data AS ({" UNION ALL ".join(f"SELECT row_id, {s.col_id} AS col_id, {s.name} AS x FROM base WHERE {s.name} IS NOT NULL" for s in SPECS)}),
cells AS (SELECT p.row_id, p.chain, p.view_id, p.cluster_id, d.col_id, d.x FROM parts p JOIN cp ON cp.chain = p.chain AND cp.view_id = p.view_id JOIN data d ON d.row_id = p.row_id AND d.col_id = cp.col_id),
sizes AS (SELECT chain, view_id, cluster_id, count(*) AS n_rows FROM parts GROUP BY ALL),
hyp AS (SELECT col_id, avg(x) AS mu, var_pop(x) + 1e-6 AS s FROM data GROUP BY col_id),
ss AS (SELECT c.chain, c.view_id, c.cluster_id, c.col_id, count(*) AS n, sum(x) AS sx, sum(x*x) AS sxx, sum(sin(x)) AS ssin, sum(cos(x)) AS scos, {", ".join(f"sum(CASE WHEN x = {k} THEN 1 ELSE 0 END) AS k{k}" for k in range(5))} FROM cells c GROUP BY ALL),
sc AS (SELECT ss.*, hyp.mu, hyp.s, 2.0+n AS nu1, 1.0+n AS r1, (hyp.mu+sx)/(1.0+n) AS mu1, greatest(2*hyp.s+sxx-sx*sx/n+n*(hyp.mu-sx/n)*(hyp.mu-sx/n)/(1.0+n), 1e-30) AS v1,
  sqrt(pow(scos+cos(pi()),2)+pow(ssin+sin(pi()),2)) AS res, atan2(ssin+sin(pi()), scos+cos(pi())) AS dir FROM ss JOIN hyp ON hyp.col_id = ss.col_id),
grid AS (SELECT chain, view_id, cluster_id, m, {"+".join(f"k{k}*ln({_level('m', k)})" for k in range(5))} - 0.5*(ln(2*pi())+ln(4.0)+m*m/4.0) AS w FROM (SELECT *, -8.0 + 16.0*unnest(range(31))/30 AS m FROM ss WHERE col_id = 4)),
top AS (SELECT chain, view_id, cluster_id, max(w) AS t, max(w) + ln(sum(exp(w - mw))) AS total FROM (SELECT *, max(w) OVER (PARTITION BY chain, view_id, cluster_id) AS mw FROM grid) GROUP BY ALL),
lv AS (
  SELECT chain, view_id, cluster_id, col_id, unnest(range(5)) AS level, unnest([{", ".join(f"ln(greatest((k{k}+1.0)/(n+5.0), 1e-30))" for k in range(5))}]) AS lp FROM ss WHERE col_id = 2
  UNION ALL SELECT chain, view_id, cluster_id, col_id, unnest([0,1]), unnest([ln(greatest(1-(sx+1.0)/(n+2.0),1e-30)), ln(greatest((sx+1.0)/(n+2.0),1e-30))]) FROM ss WHERE col_id = 3
  UNION ALL SELECT g.chain, g.view_id, g.cluster_id, 4, unnest(range(5)), unnest([{", ".join(f"ln(greatest(sum(exp(w - total)*{_level('m', k)}), 1e-30))" for k in range(5))}]) FROM grid g JOIN top t ON t.chain = g.chain AND t.view_id = g.view_id AND t.cluster_id = g.cluster_id GROUP BY g.chain, g.view_id, g.cluster_id
),
"""


def logp_sql(cells: str) -> str:
    """ln p of rows (…, chain, view_id, cluster_id, col_id, x) of the table `cells` under their cluster."""
    student = "lgamma((nu1+1)/2)-lgamma(nu1/2)-0.5*ln(nu1*pi()*(v1/nu1*(1+1/r1))) - (nu1+1)/2*ln(1+(x-mu1)*(x-mu1)/(nu1*(v1/nu1*(1+1/r1))))"
    cyclic = f"cos(x-dir) - ln(2*pi()) - {_i0('1.0')}"
    return f"""SELECT q.*, CASE WHEN q.col_id IN (0,1) THEN {student} WHEN q.col_id = 5 THEN {cyclic} ELSE lv.lp END AS logp
  FROM {cells} q JOIN sc ON sc.chain = q.chain AND sc.view_id = q.view_id AND sc.cluster_id = q.cluster_id AND sc.col_id = q.col_id
  LEFT JOIN lv ON lv.chain = q.chain AND lv.view_id = q.view_id AND lv.cluster_id = q.cluster_id AND lv.col_id = q.col_id AND lv.level = CAST(q.x AS INT)"""


MARGINAL = f"""CASE WHEN col_id IN (0,1) THEN -n/2.0*ln(2*pi()) + 0.5*ln(1/r1) + ln(s) - nu1/2*ln(v1/2) + lgamma(nu1/2) - lgamma(1.0)
  WHEN col_id = 2 THEN {"+".join(f"lgamma(k{k}+1.0)" for k in range(5))} - lgamma(n+5.0) + lgamma(5.0)
  WHEN col_id = 3 THEN lgamma(sx+1) + lgamma(n-sx+1) - lgamma(n+2.0)
  WHEN col_id = 4 THEN (SELECT total FROM top WHERE top.chain = sc.chain AND top.view_id = sc.view_id AND top.cluster_id = sc.cluster_id) + ln(16.0/30)
  ELSE -n*ln(2*pi()) + {_i0('res')} - n*{_i0('1.0')} - {_i0('1.0')} END"""
