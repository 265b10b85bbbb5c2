"""Quality selection by ordinal cumulative-link regression over hashed text features.

Grades: 0 toxic, 1 poor, 2 good. P(grade <= k) = sigmoid(t_k - w.x) with one weight vector w for all thresholds
t_0 < t_1, so a document gets its expected grade and the tail probability P(grade >= 2).

The model is fitted on at most `sample` labelled documents, those of smallest hashed id (a documented bound; the labels
have the fields doc_id, quality, toxic); everything else runs over all rows. Features are the presence of hashed words
and word beginnings that at least `min_df` fitted documents hold, penalised the less the more they go with the grade (so
that a few hundred labels are enough to tell insults from chance), and binned shares of capitals, digits, '!', '|',
other symbols and distinct words.
Weights are a fixed-size array (2 ** BITS floats) sent to every task; scoring is one pass without a shuffle.

Null or empty text: no words, scored from the thresholds and bins alone. Null ids and repeated rows pass through.
Without labelled documents of two grades nothing can be learnt: every document gets tail 1.0 and is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.shared import encoded, ids_and_text, portions, table, word_hashes

BITS = 18
BINS = 16
GRADES = 3
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
PREFIXES = (4, 5)
UPPER, DIGITS, SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"*%&#$<>{}~^_=+\\"
GROUPS = 6
#: Rows of a batch whose texts, hashes and features a worker holds at once.
SLICE = 256
#: The value of a bin's feature where words have 1: a few bins must outweigh the many words of a long document.
BIN_VALUE = 5.0
#: Squared z scores up to CHANCE are what random words of a few thousand reach; LEAST bounds the penalty of those.
CHANCE, LEAST = 9.0, 0.05


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, each text's distinct, and offsets. Bins come first: GROUPS groups of BINS."""
    out, ends = [], [0]
    for a, b in portions(texts):
        h, at, *heads = word_hashes(texts[a:b], PUNCTUATION, PREFIXES)
        slots = [(x >> np.uint64(64 - BITS)).astype(np.int64) + GROUPS * BINS for x in (h, *heads)]
        for k, t in enumerate(texts[a:b]):
            whole, *begun = (np.unique(x[at[k] : at[k + 1]]) for x in slots)
            own = np.unique(np.concatenate([whole, *begun]))
            n, words = max(1, len(t)), at[k + 1] - at[k]
            gone = lambda chars: len(t) - len(t.translate(None, chars))
            shares = (gone(UPPER) / n, gone(DIGITS) / n, min(1, 8 * t.count(b"!") / n), min(1, 8 * t.count(b"|") / n), min(1, 4 * gone(SYMBOLS) / n), len(whole) / max(1, words))
            out.append(np.concatenate([[g * BINS + min(BINS - 1, int(BINS * s)) for g, s in enumerate(shares)], own]))
            ends.append(ends[-1] + len(out[-1]))
    return (np.concatenate(out) if out else np.zeros(0)).astype(np.int32), np.array(ends)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Cumulative-link model; fitted by full-batch Adam on the penalised likelihood."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, index: np.ndarray, ends: np.ndarray, grade: np.ndarray, min_df: int = 3, steps: int = 150, ridge: float = 6.0, bin_ridge: float = 0.02):
        size = GROUPS * BINS + (1 << BITS)
        used = np.bincount(index, minlength=size) >= min_df
        column = np.cumsum(used) - 1
        keep = used[index]
        row = np.repeat(np.arange(len(grade)), np.diff(ends))[keep]
        col = column[index[keep]]
        value = np.where(index[keep] < GROUPS * BINS, BIN_VALUE, 1.0)
        m, k = int(used.sum()), GRADES - 1
        # A word is held back the less, the more its presence goes with the grade: by its squared z score over that of chance.
        held = np.bincount(col, minlength=m).astype(float)
        spread = grade - grade.mean()
        z2 = np.bincount(col, spread[row], minlength=m) ** 2 / np.maximum(spread.var() * held * (1 - held / len(grade)), 1e-9)
        pull = np.where(np.flatnonzero(used) < GROUPS * BINS, bin_ridge, ridge / np.maximum(z2 - CHANCE, LEAST))
        share = np.clip([(grade <= j).mean() for j in range(k)], 0.01, 0.99)
        first = np.log(share / (1 - share))
        # Thresholds as the first and log gaps keeps them in order.
        p = np.concatenate([np.zeros(m), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
        mean, square = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, steps + 1):
            w, t = p[:m], np.cumsum(np.concatenate([p[m : m + 1], np.exp(p[m + 1 :])]))
            eta = np.bincount(row, w[col] * value, minlength=len(grade))
            edges = np.concatenate([np.full((len(grade), 1), -np.inf), t - eta[:, None], np.full((len(grade), 1), np.inf)], axis=1)
            cdf = np.where(np.isfinite(edges), sigmoid(edges), edges > 0)
            at = np.arange(len(grade))
            lo, hi = cdf[at, grade], cdf[at, grade + 1]
            prob = np.maximum(hi - lo, 1e-9)
            d_lo, d_hi = lo * (1 - lo) / prob, hi * (1 - hi) / prob
            g_eta = d_hi - d_lo  # of the negative log-likelihood by eta
            g_t = np.array([(d_lo * (grade == j + 1)).sum() - (d_hi * (grade == j)).sum() for j in range(k)])
            g_p = np.concatenate([np.bincount(col, g_eta[row] * value, minlength=m) + pull * w, [g_t.sum()], np.exp(p[m + 1 :]) * np.cumsum(g_t[::-1])[::-1][1:]])
            mean, square = 0.9 * mean + 0.1 * g_p, 0.99 * square + 0.01 * g_p**2
            p = p - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights = np.zeros(size, dtype=np.float32)
        weights[used] = p[:m]
        weights[: GROUPS * BINS] *= BIN_VALUE
        return cls(weights, np.cumsum(np.concatenate([p[m : m + 1], np.exp(p[m + 1 :])])))

    def score(self, index: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= the highest)."""
        eta = np.add.reduceat(self.weights[index].astype(np.float64), ends[:-1]) if len(index) else np.zeros(0)
        above = 1 - sigmoid(self.thresholds - eta[:, None])
        return above.sum(axis=1), above[:, -1]


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    """None where the sample holds fewer than two grades. The sample's features, not its texts, come to the driver."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = ids_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")

    def featured(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                index, ends = features(encoded(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([index[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())], ["doc_id", "grade", "index"])

    one = texts.mapInArrow(featured, "doc_id long, grade int, index binary").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("index").alias("index"))
    rows = sorted((g, bytes(i)) for g, i in one.select("grade", "index").toLocalIterator())
    grades = np.array([g for g, _ in rows], dtype=np.int64)
    if len({*grades.tolist()}) < 2:
        return None
    parts = [np.frombuffer(i, dtype=np.int32) for _, i in rows]
    return Ordinal.fit(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), grades)


def score_quality(docs: DataFrame, model: Ordinal | None, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (struct of all input columns), doc_id, expected_grade, tail, keep for each input row; keep is tail >= cut."""
    source = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if model is None:
        return source.select("row", "doc_id", F.lit(float(GRADES - 1)).alias("expected_grade"), F.lit(1.0).alias("tail"), F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("expected_grade double, tail double")
    def scored(texts: pa.Array) -> pa.Array:
        done = [sent.value.score(*features(encoded(texts.slice(a, SLICE)))) for a in range(0, len(texts), SLICE)]
        expected, tail = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0), np.zeros(0))
        return pa.StructArray.from_arrays([pa.array(expected), pa.array(tail)], ["expected_grade", "tail"])

    return source.withColumn("s", scored("text")).select("row", "doc_id", "s.expected_grade", "s.tail", (F.col("s.tail") >= cut).alias("keep"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).drop("row")
