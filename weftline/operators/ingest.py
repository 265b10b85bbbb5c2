"""Typing, encoding and quality of raw columns before modelling: one aggregate or a small dimension table each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import components as K

#: The tokens that mean a missing cell.
MISSING = ("", "NA", "nan", "NaN", "NULL", "None", "null", "N/A", ".")
c = F.col


def clean(x: Column) -> Column:
    """NaN and infinities as NULL."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def guess_column_types(df: DataFrame, names: Sequence[str] | None = None, count_cutoff: int = 20, ratio_cutoff: float = 0.02) -> DataFrame:
    """(name, stat_type, n_unique, n): from one pass. All missing: CONTINUOUS; {0, 1}: BINARY; whole numbers, few or rarely
    distinct: CATEGORICAL."""
    names = df.columns if names is None else list(names)
    aggs = []
    for i, name in enumerate(names):
        x = clean(c(f"`{name}`"))
        whole = F.abs(x - F.rint(x)) <= 1e-8 + 1e-5 * F.abs(F.rint(x))
        aggs.append(F.struct(F.lit(name).alias("name"), F.countDistinct(x).alias("n_unique"), F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.coalesce(F.bool_and(whole), F.lit(False)).alias("whole")).alias(f"c{i}"))
    rows = df.agg(*aggs).select(F.inline(F.array(*(f"c{i}" for i in range(len(names))))))
    binary = (c("n_unique") <= 2) & c("lo").isin(0.0, 1.0) & c("hi").isin(0.0, 1.0)
    few = c("whole") & ((c("n_unique") <= count_cutoff) | (c("n_unique") / c("n") < ratio_cutoff))
    kind = F.when(c("n") == 0, K.CONTINUOUS).when(binary, K.BINARY).when(few, K.CATEGORICAL).otherwise(K.CONTINUOUS)
    return rows.select("name", kind.alias("stat_type"), "n_unique", "n")


def column_codes(df: DataFrame, name: str) -> DataFrame:
    """(value, code): distinct values in order; codes do not change the data."""
    x = c(f"`{name}`")
    return df.where(x.isNotNull()).select(x.alias("value")).distinct().withColumn("code", (F.row_number().over(W.orderBy("value")) - 1).cast("int"))


def encode_sorted(df: DataFrame, name: str, out: str) -> DataFrame:
    """Adds the rank of a value among the distinct ones; missing stays missing. The distinct values are a dimension table."""
    codes = column_codes(df, name).select(c("value").alias("_v"), c("code").alias(out))
    return df.join(codes, c(f"`{name}`") == c("_v"), "left").drop("_v")


def encode_frequency(df: DataFrame, name: str, out: str, min_count: int = 1) -> DataFrame:
    """Codes by falling frequency, ties by value; values rarer than min_count share the last code (OTHER)."""
    x = c(f"`{name}`")
    counts = df.where(x.isNotNull()).groupBy(x.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    common = counts.where(c("_n") >= min_count).withColumn("_code", F.row_number().over(W.orderBy(F.desc("_n"), "_v")) - 1)
    other = common.agg(F.count(F.lit(1)).alias("_other"))
    return df.join(common.select("_v", "_code"), x == c("_v"), "left").join(other, F.lit(True)).withColumn(out, F.when(x.isNotNull(), F.coalesce("_code", "_other")).cast("int")).drop("_v", "_code", "_other")


def encode_with(df: DataFrame, name: str, out: str, codes: dict[str, int]) -> DataFrame:
    """By a given map (binary and ordinal recipes); values outside it become missing."""
    table = F.create_map(*(x for k, v in codes.items() for x in (F.lit(k), F.lit(v))))
    return df.withColumn(out, F.try_element_at(table, c(f"`{name}`")))


def cyclic(x: Column, period: float, offset: float = 0.0) -> Column:
    """Angle in [0, 2 pi)."""
    return F.pmod(x - offset, F.lit(period)) / period * (2 * math.pi)


def datetime_parts(df: DataFrame, name: str) -> DataFrame:
    """Adds hour, weekday (Monday 0), month, year, day."""
    t = c(f"`{name}`")
    return df.withColumns({f"{name}_hour": F.hour(t), f"{name}_weekday": F.weekday(t), f"{name}_month": F.month(t), f"{name}_year": F.year(t), f"{name}_day": F.day(t)})


def discretize(df: DataFrame, name: str, out: str, n_bins: int = 10) -> DataFrame:
    """Bin numbers of equal width between minimum and maximum; the maximum belongs to the last bin, missing stays missing."""
    x = clean(c(f"`{name}`"))
    lo_hi = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (c("_hi") - c("_lo")) / n_bins
    bin_ = F.when(width == 0, 0).otherwise(F.least(F.floor((x - c("_lo")) / width), F.lit(n_bins - 1)))
    return df.join(lo_hi, F.lit(True)).withColumn(out, F.when(x.isNotNull(), bin_).cast("int")).drop("_lo", "_hi")


def zscore(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns as z scores; 0 where the deviation is under 1e-6."""
    stats = df.agg(*(f(c(f"`{n}`")).alias(f"_{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    both = df.join(stats, F.lit(True))
    return both.withColumns({n: F.when(c(f"_s{i}") < 1e-6, F.lit(0.0) * c(f"`{n}`")).otherwise((c(f"`{n}`") - c(f"_m{i}")) / c(f"_s{i}")) for i, n in enumerate(names)}).drop(*stats.columns)


def log_if_positive(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """ln(1 + x) of columns whose values are all positive."""
    lows = df.agg(*(F.min(c(f"`{n}`")).alias(f"_l{i}") for i, n in enumerate(names)))
    return df.join(lows, F.lit(True)).withColumns({n: F.when(c(f"_l{i}") > 0, F.log1p(c(f"`{n}`"))).otherwise(c(f"`{n}`")) for i, n in enumerate(names)}).drop(*lows.columns)


def drop_uninformative(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Names that are neither constant nor all distinct."""
    got = df.agg(F.count(F.lit(1)).alias("n"), *(F.countDistinct(c(f"`{n}`")).alias(f"d{i}") for i, n in enumerate(names))).first()
    return [n for i, n in enumerate(names) if 1 < got[f"d{i}"] < got.n]


def coverage(df: DataFrame, names: Sequence[str], at_least: float) -> list[str]:
    got = df.agg(*(F.avg(c(f"`{n}`").isNotNull().cast("double")).alias(f"d{i}") for i, n in enumerate(names))).first()
    return [n for i, n in enumerate(names) if (got[f"d{i}"] or 0) >= at_least]


def profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """By numeric column: counts, missing share, extremes, mean, sd, skewness, zeros and 3-sigma outliers; two passes."""
    stats = df.agg(*(F.struct(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.count(x := c(f"`{n}`")).alias("n"), F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"), F.median(x).alias("median"), F.countDistinct(x).alias("n_unique"), F.count_if(x == 0).alias("zeros")).alias(f"c{i}") for i, n in enumerate(names)))
    far = df.join(stats.select(*(F.struct(f"c{i}.mean", f"c{i}.sd").alias(f"s{i}") for i in range(len(names)))), F.lit(True)).agg(*(F.count_if((c(f"s{i}.sd") > 0) & (F.abs(c(f"`{n}`") - c(f"s{i}.mean")) > 3 * c(f"s{i}.sd"))).alias(f"o{i}") for i, n in enumerate(names)))
    both = stats.join(far, F.lit(True)).select(F.inline(F.array(*(F.struct(f"c{i}.*", c(f"o{i}").alias("outliers")) for i in range(len(names))))))
    return both.withColumn("missing", 1 - c("n") / c("n_rows")).withColumn("constant", c("n_unique") <= 1)


def missing_correlation(df: DataFrame, names: Sequence[str], limit: float = 0.7) -> DataFrame:
    """Pairs of columns whose cells go missing together."""
    gone = df.select(*(c(f"`{n}`").isNull().cast("double").alias(f"m{i}") for i, n in enumerate(names)))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    got = gone.agg(*(F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.corr(f"m{i}", f"m{j}").alias("r")).alias(f"p{i}_{j}") for i, j in pairs))
    return got.select(F.inline(F.array(*got.columns))).where(F.abs("r") > limit)


def top_values(df: DataFrame, name: str, k: int = 5) -> DataFrame:
    return df.groupBy(c(f"`{name}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def duplicate_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(c("_n") - 1), F.lit(0)).alias("duplicates"))


def validate_rules(df: DataFrame, required: Sequence[str] = (), min_rows: int = 0, max_missing: float = 1.0, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(severity, rule, column_name, detail): errors for absent columns and too few rows, warnings for the rest."""
    absent = [n for n in required if n not in df.columns]
    ranges = {k: v for k, v in (ranges or {}).items() if k in df.columns}
    seen = [n for n in required if n in df.columns]
    got = df.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c(f"`{n}`").isNull().cast("double")).alias(f"m{i}") for i, n in enumerate(seen)), *(F.count_if((c(f"`{n}`") < lo) | (c(f"`{n}`") > hi)).alias(f"r{i}") for i, (n, (lo, hi)) in enumerate(ranges.items()))).first()
    out = [("error", "required", n, "absent") for n in absent] + ([("error", "min_rows", "", str(got.n))] if got.n < min_rows else [])
    out += [("warning", "max_missing", n, f"{got[f'm{i}']:.4f}") for i, n in enumerate(seen) if (got[f"m{i}"] or 0) > max_missing]
    out += [("warning", "range", n, str(got[f"r{i}"])) for i, n in enumerate(ranges) if got[f"r{i}"]]
    return df.sparkSession.createDataFrame(out, "severity string, rule string, column_name string, detail string")


def check_categories(df: DataFrame, levels: dict[str, int]) -> None:
    """ValueError if a code is negative or not below its number of levels."""
    got = df.agg(*(f(c(f"`{n}`")).alias(f"{k}{i}") for i, n in enumerate(levels) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    bad = [n for i, (n, k) in enumerate(levels.items()) if got[f"lo{i}"] is not None and (got[f"lo{i}"] < 0 or got[f"hi{i}"] >= k)]
    if bad:
        raise ValueError(f"codes out of range in {bad}")


def remaining_life(df: DataFrame, unit: str, time: str, cap: float, out: str = "rul") -> DataFrame:
    """Periods to a unit's last one, capped."""
    return df.withColumn(out, F.least(F.max(c(time)).over(W.partitionBy(unit)) - c(time), F.lit(cap)))


def latest(df: DataFrame, key: str, time: str, names: Sequence[str]) -> DataFrame:
    """By key, each column's latest value that is not missing."""
    return df.groupBy(key).agg(*(F.max_by(c(f"`{n}`"), F.when(c(f"`{n}`").isNotNull(), c(time))).alias(n) for n in names))


def regimes(df: DataFrame, names: Sequence[str], decimals: int = 0, out: str = "regime") -> DataFrame:
    """Dense numbers of the distinct rounded settings, in their order."""
    key = F.struct(*(F.round(c(f"`{n}`"), decimals).alias(f"k{i}") for i, n in enumerate(names)))
    codes = df.select(key.alias("_k")).distinct().withColumn(out, (F.row_number().over(W.orderBy("_k")) - 1).cast("int"))
    return df.withColumn("_k", key).join(codes, "_k", "left").drop("_k")


def suggest_max_clusters(n_rows: int) -> int:
    if n_rows < 0:
        raise ValueError("n_rows must not be negative")
    return min(32, max(4, math.isqrt(n_rows)))


def split(df: DataFrame, keys: Sequence[str], share: float, seed: int = 0, out: str = "train") -> DataFrame:
    """Marks about `share` of the rows; a row's side depends on the seed and its keys alone, so rows of one key stay together."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(c(f"`{k}`").cast("string") for k in keys)).cast("binary")), 1, 8), 16, 10)
    return df.withColumn(out, drawn.cast("double") / float(1 << 32) < share)


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a whose keys no row of b has; null keys are in no other table."""
    return a.join(b.select(*keys).distinct(), [*keys], "left_anti")
