"""New rows into a fitted model, from batches or a stream, and scoring of a stream under a frozen model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from weftline.functions.math import gumbel
from weftline.operators import components as K
from weftline.operators.ingest import check_categories
from weftline.operators.queries import CLUSTER, alpha_of, anomaly_scores
from weftline.operators.suffstats import sizes, suffstats
from weftline.plans import store
from weftline.plans.model import PARTS, Model

c = F.col


def place_rows(model: Model, new: DataFrame, seed: int = 0) -> DataFrame:
    """New rows with `parts`: in each view a draw from ln n_c + ln p, or ln alpha + ln prior p for a cluster of its own. The
    rows of a batch see the statistics before it; births of one batch in a view share one cluster."""
    keys = sorted({(ch, v) for (ch, _), v in model.views.items()})
    blank = F.array(*(F.struct(F.lit(a).alias("chain"), F.lit(b).alias("view_id"), F.lit(-1).alias("cluster_id")) for a, b in keys)).cast(PARTS)
    bare = new.withColumn("parts", blank)
    stats = suffstats(model)
    none = model.hyper_table().withColumns({"cluster_id": F.lit(-1), "n": F.lit(0).cast("long"), "sx": F.lit(0.0), "sxx": F.lit(0.0), "ssin": F.lit(0.0), "scos": F.lit(0.0), "n_rows": F.lit(0).cast("long")})
    zero = F.when(c("stat_type").isin(K.CATEGORICAL, K.ORDINAL), F.transform(F.sequence(F.lit(0), c("n_levels") - 1), lambda i: F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    table = K.scorer(stats.unionByName(none.withColumn("counts", zero), allowMissingColumns=True)).withColumnRenamed("cluster_id", "candidate").drop("n_rows", "name")
    scored = model.cells(bare).drop("cluster_id").join(table, ["chain", "view_id", "col_id"]).groupBy("row_id", "chain", "view_id", "candidate").agg(F.sum(K.cell_logp(c("x"))).alias("logp"))
    counts = sizes(model)
    births = counts.groupBy("chain", "view_id").agg((F.max("cluster_id") + 1).alias("birth"))
    weights = counts.select("chain", "view_id", c("cluster_id").alias("candidate"), F.log(c("n_rows").cast("double")).alias("lw")).unionByName(births.select("chain", "view_id", F.lit(-1).alias("candidate"), F.log(alpha_of(model)).alias("lw")))
    # Rows without observed cells in a view draw from the weights alone.
    every = model.assigned(bare).select("row_id", "chain", "view_id").join(weights, ["chain", "view_id"]).join(scored, ["row_id", "chain", "view_id", "candidate"], "left")
    drawn = every.withColumn("score", c("lw") + F.coalesce("logp", F.lit(0.0)) + gumbel(seed, "row_id", "chain", "view_id", "candidate")).groupBy("row_id", "chain", "view_id").agg(F.max_by("candidate", "score").alias("k")).join(births, ["chain", "view_id"])
    parts = drawn.withColumn("cluster_id", F.when(c("k") < 0, c("birth")).otherwise(c("k")).cast("int")).groupBy("row_id").agg(F.collect_list(F.struct(*CLUSTER)).cast(PARTS).alias("parts"))
    return new.join(parts, "row_id")


def insert_rows(model: Model, new: DataFrame, seed: int = 0) -> Model:
    """The model with the new rows; ValueError on codes that its columns do not have, or columns that are absent."""
    absent = [s.name for s in model.columns if s.name not in new.columns]
    if absent:
        raise ValueError(f"columns missing: {absent}")
    check_categories(new, {s.name: max(s.n_levels, 2 if s.stat_type == K.BINARY else 0) for s in model.columns if s.stat_type in (K.CATEGORICAL, K.ORDINAL, K.BINARY)})
    placed = place_rows(model, new.select(*(x for x in model.rows.columns if x != "parts")), seed)
    return model.with_(rows=store.settle(model.rows.unionByName(placed.select(*model.rows.columns))))


def sample_and_insert(model: Model, partial: DataFrame, seed: int = 0) -> Model:
    """Rows go in under what is observed; missing cells are then filled by draws under the clusters that they went to."""
    from weftline.operators.sampling import sample_rows

    placed = place_rows(model, partial.select(*(x for x in model.rows.columns if x != "parts")), seed)
    chain = min(model.chains)
    draws = sample_rows(model, [s.col_id for s in model.columns], len(model.chains), seed, placed).where(c("chain") == chain)
    wide = draws.groupBy("row_id").agg(*(F.max(F.when(c("col_id") == s.col_id, c("value"))).alias(f"_{s.col_id}") for s in model.columns))
    filled = placed.join(wide, "row_id", "left").withColumns({s.name: F.coalesce(c(f"`{s.name}`"), c(f"_{s.col_id}")) for s in model.columns})
    return model.with_(rows=store.settle(model.rows.unionByName(filled.select(*model.rows.columns))))


def insert_stream(stream: DataFrame, model: Model, base: str, seed: int = 0) -> DataStreamWriter:
    """Each micro-batch goes into the latest stored model and is stored under its number; a replayed batch writes the same
    folder again from the model before it. Order across batches does not matter to the model (rows are exchangeable)."""
    spark = model.spark
    if store.latest_checkpoint(spark, base) is None:
        store.save_checkpoint(model, base, 0)

    def step(batch: DataFrame, number: int) -> None:
        path, target = store.latest_checkpoint(spark, base), f"{base}/sweep={number + 1:08d}"
        if path is not None and path >= target:
            path = f"{base}/sweep={number:08d}"
        store.save_checkpoint(insert_rows(store.load(spark, path), batch, seed + number), base, number + 1)

    return stream.writeStream.foreachBatch(step)


def score_stream(stream: DataFrame, model: Model, path: str) -> DataStreamWriter:
    """Anomaly scores of new rows under a frozen model, appended to Parquet: rows are placed, then scored."""

    def step(batch: DataFrame, number: int) -> None:
        rows = place_rows(model, batch.select(*(x for x in model.rows.columns if x != "parts")), number)
        anomaly_scores(model, rows).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(step)
