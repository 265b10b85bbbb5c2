"""Models on disk: one folder of Parquet tables and a manifest written last; numbered checkpoints; lineage cuts."""

from __future__ import annotations

import json
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.model import ColumnSpec, Model

VERSION = 1


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder named by spark.checkpoint.dir; a temporary one only in local mode where none is set."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-"))
    return df.checkpoint(eager=True)


def save(model: Model, path: str, **extra) -> None:
    """Rows first, the manifest last: a folder without a manifest is no model."""
    spark = model.spark
    model.rows.write.mode("overwrite").parquet(f"{path}/rows")
    manifest = {
        "version": VERSION, "columns": [[s.col_id, s.name, s.stat_type, s.n_levels] for s in model.columns], "views": [[*k, v] for k, v in model.views.items()],
        "hypers": [[*k, v] for k, v in model.hypers.items()], "alphas": [[*k, v] for k, v in model.alphas.items()], "col_alphas": [[k, v] for k, v in model.col_alphas.items()], "extra": extra,
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> dict:
    found = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if found["version"] > VERSION:
        raise ValueError(f"the model is of version {found['version']}; this reads up to {VERSION}")
    return found


def load(spark: SparkSession, path: str) -> Model:
    m = manifest(spark, path)
    pair = lambda rows: {(a, b): v for a, b, v in rows}
    return Model(spark.read.parquet(f"{path}/rows"), [ColumnSpec(*x) for x in m["columns"]], pair(m["views"]), pair(m["hypers"]), pair(m["alphas"]), {k: v for k, v in m["col_alphas"]})


def save_checkpoint(model: Model, base: str, sweep: int, **extra) -> None:
    save(model, f"{base}/sweep={sweep:08d}", sweep=sweep, **extra)


def latest_checkpoint(spark: SparkSession, base: str) -> str | None:
    """The folder of the highest sweep that has a manifest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted((s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("sweep=")), reverse=True)
    return next((f"{base}/{n}" for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/manifest/_SUCCESS"))), None)


def append_trace(spark: SparkSession, trace: list[dict], path: str) -> None:
    """Metrics sink: (sweep, chain, metric, value) appended as Parquet."""
    rows = [(t["sweep"], t["chain"], k, float(v)) for t in trace for k, v in t.items() if k not in ("sweep", "chain")]
    spark.createDataFrame(rows, "sweep int, chain int, metric string, value double").write.mode("append").parquet(path)


def resumable(spark: SparkSession, path: str, model: Model) -> bool:
    """Whether the stored run has the same chains and columns."""
    m = manifest(spark, path)
    return [x[:3] for x in m["columns"]] == [[s.col_id, s.name, s.stat_type] for s in model.columns] and {x[0] for x in m["views"]} == {*model.chains}
