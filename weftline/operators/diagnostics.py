"""Agreement of partitions, convergence of chains, evaluation against truth."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.model import Model
from weftline.plans.store import settle

c = F.col


def adjusted_rand_index(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (ari) for a table of two labels; 1 where both partitions are trivially equal, 0 where only the scale fails."""
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    n = c("n").cast("double")
    both = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    s = both.agg(pairs(n).alias("both"), (F.sum("n") * (F.sum("n") - 1) / 2).alias("all"), F.count(F.lit(1)).alias("kinds"))
    sa, sb = (both.groupBy(x).agg(F.sum("n").alias("n")).agg(pairs(n).alias(f"s_{k}"), F.count(F.lit(1)).alias(f"n_{k}")) for k, x in (("a", a), ("b", b)))
    one = s.join(sa, F.lit(True)).join(sb, F.lit(True))
    expected = c("s_a") * c("s_b") / c("all")
    top = (c("s_a") + c("s_b")) / 2
    same = (c("kinds") == c("n_a")) & (c("kinds") == c("n_b"))
    return one.select(F.when((c("all") == 0) | (F.abs(top - expected) < 1e-12), F.when(same, 1.0).otherwise(0.0)).otherwise((c("both") - expected) / (top - expected)).alias("ari"))


def row_ari(model: Model, truth: DataFrame, chain: int, view_id: int) -> DataFrame:
    """Agreement of a view's clusters with true labels (row_id, label)."""
    own = model.assigned().where((c("chain") == chain) & (c("view_id") == view_id)).select("row_id", c("cluster_id").alias("a"))
    return adjusted_rand_index(own.join(truth.select("row_id", c("label").alias("b")), "row_id"))


def column_ari(model: Model, truth: dict[int, int]) -> DataFrame:
    """(chain, ari): agreement of each chain's views with true ones by col_id; as small as the model's column table."""
    chains = [adjusted_rand_index(model.spark.createDataFrame([(model.views[ch, col], v) for col, v in truth.items()], "a int, b int")).select(F.lit(ch).alias("chain"), "ari") for ch in model.chains]
    return reduce(DataFrame.unionAll, chains)


def gelman_rubin(trace: DataFrame, flag_constant: bool = False) -> DataFrame:
    """(metric, rhat) of trace(chain, sweep, metric, value): split chains, at least 1; 1 where the within variance vanishes
    (NULL with flag_constant, if the chains then differ). Metrics with under 2 chains or 4 samples are an error."""
    sizes = trace.groupBy("metric", "chain").agg(F.count(F.lit(1)).alias("n")).groupBy("metric").agg(F.count(F.lit(1)).alias("chains"), F.min("n").alias("n"))
    bad = sizes.where((c("chains") < 2) | (c("n") < 4)).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].metric}: at least two chains of four samples are needed")
    place = F.row_number().over(W.partitionBy("metric", "chain").orderBy("sweep")) - 1
    t = trace.withColumn("place", place).join(sizes.select("metric", (c("n") / 2).cast("int").alias("half")), "metric")
    halves = t.where(c("place") < 2 * c("half")).groupBy("metric", "chain", (c("place") >= c("half")).alias("second"), "half").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    s = halves.groupBy("metric", "half").agg(F.avg("v").alias("w"), (F.var_samp("m") * c("half")).alias("b"))
    ratio = F.sqrt(((c("half") - 1) / c("half") * c("w") + c("b") / c("half")) / c("w"))
    flat = F.when(F.lit(flag_constant) & (c("b") > 1e-10), F.lit(None)).otherwise(1.0)
    return s.select("metric", F.when(c("w") <= 1e-10, flat).otherwise(F.greatest(F.lit(1.0), ratio)).alias("rhat"))


def numbered(trace: DataFrame) -> DataFrame:
    """(metric, chain, t, value), t the place by sweep in the chain from 0: ranges of sweeps are counted, so no task holds a chain."""
    ranged = settle(trace.select("metric", "chain", "sweep", "value").repartitionByRange("metric", "chain", "sweep").withColumn("part", F.spark_partition_id()))
    before = F.sum("k").over(W.partitionBy("metric", "chain").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = ranged.groupBy("metric", "chain", "part").agg(F.count(F.lit(1)).alias("k")).withColumn("start", F.coalesce(before, F.lit(0))).drop("k")
    place = F.row_number().over(W.partitionBy("metric", "chain", "part").orderBy("sweep", "value")) - 1
    return ranged.withColumn("place", place).join(starts, ["metric", "chain", "part"]).select("metric", "chain", (c("start") + c("place")).alias("t"), "value")


def lagged_sums(pieces: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(metric, chain, lag, g): sums of products over the pairs (metric, chain, i, j) of pieces (metric, chain, piece, x)."""
    key = ["metric", "chain"]
    both = pairs.join(pieces.select(*key, c("piece").alias("i"), c("x").alias("a")), [*key, "i"]).join(pieces.select(*key, c("piece").alias("j"), c("x").alias("b")), [*key, "j"])

    def summed(batches):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            for (metric, chain, o), g in held.items():
                lag = o * size + np.arange(1 - size, size)
                keep = lag >= 0
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array([metric] * n, kinds[0]), pa.array([chain] * n, kinds[1]), pa.array(lag[keep]), pa.array(g[keep])], ["metric", "chain", "lag", "g"])
            held.clear()

        for batch in batches:
            kinds = [batch.column(0).type, batch.column(1).type]
            for metric, chain, o, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4)):
                a, b = (np.pad(x := v.values.to_numpy(zero_copy_only=False), (0, size - len(x))) for v in (a, b))
                g = np.fft.irfft(np.conj(np.fft.rfft(a, 2 * size)) * np.fft.rfft(b, 2 * size), 2 * size)
                held[metric, chain, o] = held.get((metric, chain, o), 0.0) + np.concatenate([g[size + 1 :], g[:size]])
            if len(held) > 64:
                yield from flush()
        yield from flush()

    kind = {f.name: f.dataType.simpleString() for f in pieces.schema}
    rows = both.select(*key, (c("j") - c("i")).alias("o"), "a", "b").mapInArrow(summed, f"metric {kind['metric']}, chain {kind['chain']}, lag long, g double")
    return rows.groupBy(*key, "lag").agg(F.sum("g").alias("g"))


def effective_sample_size(trace: DataFrame, size: int = 4096) -> DataFrame:
    """(metric, ess): m n / (1 + 2 sum rho), autocorrelation pooled over chains, summed over pairs of lags from 1 while the
    pairs stay positive. Chains are cut to the shortest. A constant trace has autocorrelation 1.

    Chains are held in pieces of `size` samples. Products of pieces at growing distances give ever longer lags, up to where
    every metric has met a pair that is not positive, or its last lag: later lags cannot enter the sum."""
    lengths = settle(trace.groupBy("metric", "chain").agg(F.count(F.lit(1)).alias("k")).groupBy("metric").agg(F.min("k").alias("n"), F.count(F.lit(1)).alias("m")))
    t = settle(numbered(trace).join(lengths, "metric").where(c("t") < c("n")))
    t = t.join(t.groupBy("metric", "chain").agg(F.avg("value").alias("mean")), ["metric", "chain"]).select("metric", "chain", "t", (c("value") - c("mean")).alias("d"))
    pieces = settle(t.groupBy("metric", "chain", F.floor(c("t") / size).alias("piece")).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "d"))), lambda x: F.coalesce(x["d"], F.lit(math.nan))).alias("x")))
    found, open_, first, last = None, lengths, 0, 1
    while True:
        # Lags under done have all their products: those of pieces at most last apart.
        done = last * size
        own = pieces.join(open_.select("metric"), "metric", "left_semi")
        pairs = own.select("metric", "chain", c("piece").alias("i"), F.explode(F.sequence(c("piece") + first, c("piece") + last)).alias("j"))
        more = lagged_sums(own, pairs, size)
        found = settle(more if found is None else found.unionByName(more).groupBy("metric", "chain", "lag").agg(F.sum("g").alias("g")))
        acov = found.where(c("lag") < done).join(lengths, "metric").where(c("lag") < c("n")).withColumn("g", F.when(~F.isnan("g"), c("g") / c("n")))
        acov = acov.join(found.where("lag = 0").join(lengths, "metric").select("metric", "chain", F.when(~F.isnan("g"), c("g") / c("n")).alias("v")), ["metric", "chain"])
        rho = acov.withColumn("r", F.when(c("v") <= 1e-12, 1.0).otherwise(c("g") / c("v"))).groupBy("metric", "n", "m", "lag").agg(F.avg("r").alias("r"))
        sums = rho.where("lag > 0").groupBy("metric", "n", "m", F.floor((c("lag") - 1) / 2).alias("pair")).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("k")).where("k = 2")
        ends = sums.where(~F.coalesce(c("s") > 0, F.lit(False))).groupBy("metric").agg(F.min("pair").alias("end"))
        open_ = settle(lengths.where(c("n") > done).join(ends, "metric", "left_anti"))
        if open_.isEmpty():
            break
        first, last = last + 1, 2 * last + 1
    total = sums.join(ends, "metric", "left").where(c("end").isNull() | (c("pair") < c("end"))).groupBy("metric").agg(F.sum("s").alias("s"))
    total = lengths.where("n > 1").join(total, "metric", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return total.select("metric", F.least(c("n") * c("m"), c("n") * c("m") / F.greatest(1 + 2 * c("s"), F.lit(1e-12))).alias("ess"))


def regression_metrics(df: DataFrame, truth: str, guess: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    e = c(guess) - c(truth)
    aggs = [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), (1 - F.sum(e * e) / (F.var_pop(truth) * F.count(truth))).alias("r2"), F.corr(truth, guess).alias("pearson"), (F.sqrt(F.avg(e * e)) / F.stddev_pop(truth)).alias("nrmse")]
    if lo and hi:
        aggs += [F.avg(c(truth).between(c(lo), c(hi)).cast("double")).alias("coverage"), F.avg(c(hi) - c(lo)).alias("width")]
    return df.agg(*aggs)


def bma_intervals(per_chain: DataFrame, z: float = 1.96) -> DataFrame:
    """(row_id, mean, lo, hi) from (row_id, chain, mean, lo, hi): the mean over chains, widened by z deviations between them."""
    m = per_chain.groupBy("row_id").agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("sd"), F.avg("lo").alias("l"), F.avg("hi").alias("h"))
    return m.select("row_id", c("m").alias("mean"), F.least(c("m") - z * c("sd"), c("l")).alias("lo"), F.greatest(c("m") + z * c("sd"), c("h")).alias("hi"))


def best_chain(scores: DataFrame) -> DataFrame:
    """The chain of highest score (chain, log_joint); ties to the smaller number."""
    return scores.agg(F.max_by("chain", F.struct("log_joint", -c("chain"))).alias("chain"), F.max("log_joint").alias("log_joint"))
