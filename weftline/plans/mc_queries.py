"""Registered queries without SQL: draws, fitting and insertion; held to statistics in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import information, sampling
from weftline.operators.sampler import fit, initialize, row_kernel, sweep
from weftline.plans.fixtures import SPECS, orders_model, orders_rows
from weftline.streaming.insert import insert_rows

CONDITIONS = [(1, 1, 5000.0), (1, 4, 3.0), (2, 0, 90000.0)]


def predictive_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame(CONDITIONS, "query_id int, col_id int, value double")
    return sampling.sample(orders_model(spark, sf_dir), [0, 2, 3, 4, 5], 200, 1, given)


def credible_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.credible_interval(sampling.sample_rows(orders_model(spark, sf_dir), [0], 40, 2), ["row_id", "name"])


def impute_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = orders_model(spark, sf_dir)
    return sampling.impute(model, 0, 40, 3, model.rows.where("total is null"))


def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.mutual_information(orders_model(spark, sf_dir), [(0, 1), (2, 3), (4, 5)], 500, 4)


def conditional_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return information.conditional_entropy(orders_model(spark, sf_dir), 0, [1, 2], 1000, 13)


def cdf_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cdf(sampling.sample(orders_model(spark, sf_dir), [0], 2000, 5), ["name"], 150000.0)


def evaluate_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = orders_model(spark, sf_dir)
    cells = model.rows.select("row_id", F.inline(F.array(*(F.struct(F.lit(s.name).alias("name"), F.col(s.name).alias("value")) for s in model.columns))))
    mask = sampling.holdout_mask(model.rows, [s.name for s in model.columns], 0.02, 6)
    held = cells.join(mask, ["row_id", "name"])
    # The cells held out go missing in the model: it is not to know what it is asked for.
    gone = model.rows.join(mask.groupBy("row_id").agg(F.collect_set("name").alias("gone")), "row_id", "left")
    rest = gone.withColumns({s.name: F.when(F.array_contains("gone", s.name), None).otherwise(F.col(s.name)) for s in model.columns}).select(*model.rows.columns)
    return sampling.evaluate_imputation(model.with_(rows=rest), held, 20, 7)


def sweep_synchronous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_kernel(orders_model(spark, sf_dir), 8).assigned().groupBy("chain", "view_id", "cluster_id").agg(F.count(F.lit(1)).alias("n_rows"))


def fit_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, trace = fit(initialize(orders_rows(spark, sf_dir).drop("parts", "entity", "nation"), SPECS, 2, 9), 1, 10)
    return spark.createDataFrame([(t["sweep"], t["chain"], t["log_joint"]) for t in trace], "sweep int, chain int, log_joint double")


def insert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = orders_model(spark, sf_dir)
    old, new = model.rows.where("row_id % 10 > 0"), model.rows.where("row_id % 10 = 0").drop("parts")
    return insert_rows(model.with_(rows=old), new, 11).assigned().groupBy("chain", "view_id", "cluster_id").agg(F.count(F.lit(1)).alias("n_rows"))


def minibatch_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(orders_model(spark, sf_dir), 12, ("rows",), batch_size=200).assigned().groupBy("chain", "view_id", "cluster_id").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {f.__name__: f for f in (predictive_sample, credible_interval, impute_continuous, mutual_information, conditional_entropy, cdf_continuous, evaluate_imputation, sweep_synchronous, fit_chains, insert_batch, minibatch_sweep)}
