"""A table prepared by a configuration: read, check, transform, write; a run whose configuration is already there is skipped.

The configuration is a dict: source (format, path, columns), required, min_rows, ranges, filter, derive (name -> expression),
drop_uninformative, types (name -> type), output. Its hash is kept with the output, in a manifest that is written last."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.ingest import drop_uninformative, validate_rules
from weftline.sources import files

c = F.col
READERS = ("parquet", "csv", "json", "orc")
KEYS = {"source", "required", "min_rows", "ranges", "filter", "derive", "drop_uninformative", "types", "output"}


def config_hash(config: dict) -> str:
    """Of the configuration's content; the order of its keys does not matter."""
    return hashlib.md5(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def check_config(config: dict) -> None:
    unknown = {*config} - KEYS
    if unknown or not {"source", "output"} <= {*config}:
        raise ValueError(f"unknown keys {sorted(unknown)}" if unknown else "source and output are needed")
    if config["source"].get("format", "parquet") not in READERS:
        raise ValueError(f"unknown format {config['source']['format']}")


def fetched(spark: SparkSession, source: dict) -> DataFrame:
    kind = source.get("format", "parquet")
    df = files.read_csv(spark, source["path"])[0] if kind == "csv" else spark.read.format(kind).load(source["path"])
    return df.select(*(c(f"`{n}`") for n in source["columns"])) if source.get("columns") else df


def transformed(df: DataFrame, config: dict) -> DataFrame:
    if config.get("filter"):
        df = df.where(config["filter"])
    for name, expression in config.get("derive", {}).items():
        df = df.withColumn(name, F.expr(expression))
    drop = config.get("drop_uninformative", [])
    kept = {*drop_uninformative(df, drop)} if drop else set()
    return df.select(*(c(f"`{n}`") for n in df.columns if n not in drop or n in kept))


def recorded(spark: SparkSession, path: str) -> dict | None:
    """The manifest of an output, or None where there is no finished one."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    return json.loads(spark.read.text(f"{path}/manifest").first().value)


def run(spark: SparkSession, config: dict, force: bool = False) -> tuple[DataFrame, bool]:
    """(the output table, whether it was made now). ValueError on what the checks call errors, before anything is written. The
    old manifest goes first, so an interrupted run leaves an output that is not taken for a finished one."""
    check_config(config)
    out, key = config["output"], config_hash(config)
    old = recorded(spark, out)
    if old and old["config"] == key and not force:
        return spark.read.parquet(f"{out}/data"), False
    df = fetched(spark, config["source"])
    found = validate_rules(df, config.get("required", ()), config.get("min_rows", 0), 1.0, {k: tuple(v) for k, v in config.get("ranges", {}).items()}).collect()  # as many rows as rules
    errors = [r for r in found if r.severity == "error"]
    if errors:
        raise ValueError("; ".join(f"{r.rule} {r.column_name} {r.detail}" for r in errors))
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    files.save_data(transformed(df, config), f"{out}/data", config.get("types"), "zstd")
    made = spark.read.parquet(f"{out}/data")
    manifest = {"config": key, "columns": made.columns, "rows": made.count(), "warnings": [[r.rule, r.column_name, r.detail] for r in found]}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return made, True
