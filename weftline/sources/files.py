"""Readers and writers of tables: ragged CSV with missing tokens, Parquet with embedded types, Arrow IPC and NPY files."""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from weftline.operators.ingest import MISSING, clean, guess_column_types
from weftline.plans.model import ColumnSpec

c = F.col


def read_csv(spark: SparkSession, path: str, has_header: bool = True, missing: Sequence[str] = MISSING) -> tuple[DataFrame, DataFrame]:
    """(values, bad): all columns as DOUBLE, and by column the number and five examples of cells that are neither numbers nor
    missing tokens. Short rows are filled with missing cells, long ones cut. Headerless columns are col_0, col_1, …"""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    cells = [x.strip() for x in first[0].value.split(",")]
    names = cells if has_header else [f"col_{i}" for i in range(len(cells))]
    schema = StructType.fromDDL(", ".join(f"`{n}` STRING" for n in names))
    raw = spark.read.schema(schema).option("header", has_header).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    text = lambda n: F.trim(c(f"`{n}`"))
    number = lambda n: F.when(c(f"`{n}`").isNull() | text(n).isin(*missing), None).otherwise(F.expr(f"try_cast(trim(`{n}`) AS DOUBLE)"))
    values = raw.select(*(clean(number(n)).alias(n) for n in names))
    wrong = F.filter(F.array(*(F.when(c(f"`{n}`").isNotNull() & ~text(n).isin(*missing) & number(n).isNull(), F.struct(F.lit(n).alias("name"), text(n).alias("cell"))) for n in names)), lambda x: x.isNotNull())
    bad = raw.select(F.inline(wrong)).groupBy("name").agg(F.count(F.lit(1)).alias("n_bad"), F.slice(F.sort_array(F.collect_set("cell")), 1, 5).alias("examples"))
    return values, bad


def read_csv_chunked(spark: SparkSession, path: str, chunk_size: int = 10_000, has_header: bool = True, missing: Sequence[str] = MISSING) -> tuple[DataFrame, DataFrame]:
    """read_csv: files are split by Spark, so chunk_size has no part in it but must be positive."""
    if chunk_size < 1:
        raise ValueError("chunk_size must be positive")
    return read_csv(spark, path, has_header, missing)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def load_csv_data(spark: SparkSession, path: str) -> tuple[DataFrame, list[ColumnSpec]]:
    values, _ = read_csv(spark, path)
    kinds = {r.name: r.stat_type for r in guess_column_types(values).collect()}
    return values, [ColumnSpec(i, n, kinds[n]) for i, n in enumerate(values.columns)]


def save_data(df: DataFrame, path: str, column_types: dict[str, str] | None = None, compression: str = "lz4") -> None:
    """Parquet whose fields carry their type in the metadata."""
    if compression not in ("lz4", "zstd", "snappy", "uncompressed"):
        raise ValueError(f"unknown compression {compression}")
    unknown = {*(column_types or {})} - {*df.columns}
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    kinds = column_types or {}
    codec = {"lz4": "lz4_raw"}.get(compression, compression)
    df.select(*(c(f"`{n}`").alias(n, metadata={"stat_type": kinds[n]}) if n in kinds else c(f"`{n}`") for n in df.columns)).write.mode("overwrite").option("compression", codec).parquet(path)


def load_data(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> tuple[DataFrame, list[ColumnSpec]]:
    df = spark.read.parquet(path)
    absent = {*(columns or [])} - {*df.columns}
    if absent:
        raise ValueError(f"no such columns: {sorted(absent)}")
    df = df.select(*(f"`{n}`" for n in columns)) if columns else df
    return df, [ColumnSpec(i, f.name, f.metadata["stat_type"]) for i, f in enumerate(df.schema.fields) if "stat_type" in f.metadata]


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*(f"`{n}`" for n in columns)) if columns else df


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArrowFiles(DataSource):
    """Format "arrow_ipc": files of the Arrow IPC file format, one partition for each record batch."""

    @classmethod
    def name(cls):
        return "arrow_ipc"

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.memory_map(self.options["path"]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema):
        return ArrowReader(self.options["path"], [f.name for f in schema.fields])


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self):
        import pyarrow as pa

        with pa.memory_map(self.path) as f:
            return [Part(self.path, i, i + 1) for i in range(pa.ipc.open_file(f).num_record_batches)] or [Part(self.path, 0, 0)]

    def read(self, part):
        import pyarrow as pa

        with pa.memory_map(part.path) as f:
            source = pa.ipc.open_file(f)
            for i in range(part.start, part.end):
                yield source.get_batch(i).select(self.names)


class NpyFiles(DataSource):
    """Format "npy": a two-dimensional array, memory-mapped, with column names in a JSON file beside it."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return ", ".join(f"`{n}` DOUBLE" for n in npy_names(self.options["path"]))

    def reader(self, schema):
        return NpyReader(self.options["path"], [f.name for f in schema.fields], int(self.options.get("rows", 100_000)))


class NpyReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], rows: int):
        self.path, self.names, self.rows = path, names, rows

    def partitions(self):
        import numpy as np

        n = len(np.load(self.path, mmap_mode="r"))
        return [Part(self.path, i, min(n, i + self.rows)) for i in range(0, max(n, 1), self.rows)]

    def read(self, part):
        import numpy as np
        import pyarrow as pa

        x = np.load(part.path, mmap_mode="r")[part.start : part.end].astype("float64")
        yield pa.RecordBatch.from_arrays([pa.array(x[:, j], mask=np.isnan(x[:, j])) for j in range(x.shape[1])], self.names)


def npy_names(path: str) -> list[str]:
    import numpy as np

    try:
        with open(path + ".json", encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        warnings.warn(f"{path}.json is missing; columns are numbered", stacklevel=2)
        return [f"col_{i}" for i in range(np.load(path, mmap_mode="r").shape[1])]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowFiles)
    spark.dataSource.register(NpyFiles)


def save_arrow(df: DataFrame, path: str, compression: str | None = "lz4") -> None:
    """One Arrow IPC file on the driver, for tables that fit it; larger ones go to Parquet."""
    import pyarrow as pa

    if compression not in (None, "lz4", "zstd", "uncompressed"):
        raise ValueError(f"unknown compression {compression}")
    t = df.toArrow()
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, t.schema, options=pa.ipc.IpcWriteOptions(compression=None if compression == "uncompressed" else compression)) as out:
        out.write_table(t)


def save_npy(df: DataFrame, path: str) -> str:
    """One NPY file on the driver, and its names; the suffix is forced."""
    import numpy as np

    path = path if path.endswith(".npy") else path + ".npy"
    np.save(path, df.toPandas().to_numpy(dtype="float64"))
    with open(path + ".json", "w", encoding="utf-8") as f:
        json.dump(df.columns, f)
    return path


def save_npz(df: DataFrame, path: str) -> str:
    warnings.warn("use save_npy", DeprecationWarning, stacklevel=2)
    return save_npy(df, path)


def load_npz_mmap(spark: SparkSession, path: str) -> DataFrame:
    warnings.warn('use the format "npy"', DeprecationWarning, stacklevel=2)
    register(spark)
    return spark.read.format("npy").load(path)
