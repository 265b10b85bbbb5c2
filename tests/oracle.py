"""Holds every registered query that has SQL against DuckDB on the same tables."""

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(float(v), 9) + 0.0 if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(fix(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(df, con, sql):
    """None when equal, else what differs."""
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        for x, y in zip(a, b):
            if x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12)):
                return f"{dict(zip(got[0], a))} {dict(zip(got[0], b))}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con = connect(sf)
    sqls = e.oracle_sql()
    for name, f in e.queries().items():
        if name in sqls and (len(sys.argv) < 3 or name in sys.argv[2:]):
            t = time.time()
            try:
                found = differences(f(spark, sf), con, sqls[name])
            except Exception as x:  # noqa: BLE001
                found = f"{type(x).__name__}: {str(x)[:600]}"
            print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - t:.1f}s {found or ''}", flush=True)
