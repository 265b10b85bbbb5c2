"""Exact line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches of falling doc_id. A batch's distinct line hashes merge-anti-join the runs: those that no run
holds are new, and since ids fall, the batch also holds the largest doc_id they will ever have. They become a sorted run of
their own, with that id and the number of documents. Hashes that a run does hold (a merge semi join) only add to the number
of documents. So runs never share a hash, and `fan` runs of a level are compacted into one of the next without adding up. A
long line held by enough documents goes everywhere but in its largest doc_id.

A hash is two 64-bit words. Lines are counted by partial aggregates. Where lines are joined with those to drop, the lines
that make up at least 1 / HOT of all are sent to the tasks (there can be HOT at most), so no task gets more than that share.
Rows to drop are places, which gather in the row of their text; a text is cut by slices between them, in linear time. Texts
are shuffled once, by id and hash.

Null or empty text: one empty line. Rows that share a doc_id count as one document; rows without a doc_id count together
as one and never hold a line's last place. Repeated lines inside the kept document stay. Empty tables give empty results.
Other columns are carried in `row` and cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.shared import settle, table

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ("h1", "h2")
HOT = 4096


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(STRIPPED)), UPPER, LOWER)


def hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x5EED), key).alias("h2"))


class SortedRuns:
    """Runs of (h1, h2, docs, top) by level, no hash in two of them; `fan` runs of a level are compacted into one of the next."""

    def __init__(self, fan: int = 3):
        self.fan, self.levels, self.again = fan, [[]], []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def sorted_run(df: DataFrame) -> DataFrame:
        return settle(df.sortWithinPartitions(*HASH))

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of batch whose hash is in no run: a merge anti join with each of the few runs."""
        return reduce(lambda df, run: df.join(run.hint("merge"), [*HASH], "left_anti"), self.runs(), batch)

    def seen(self, batch: DataFrame) -> DataFrame:
        """Rows of batch whose hash is in a run, which is one run only."""
        return reduce(DataFrame.unionAll, [batch.join(run.hint("merge"), [*HASH], "left_semi") for run in self.runs()])

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, docs, top) of documents whose ids are below those of earlier batches."""
        if self.runs():
            self.again.append(settle(self.seen(batch).select(*HASH, "docs", F.lit(None).cast("long").alias("top"))))
        self.levels[0].append(self.sorted_run(self.unseen(batch)))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fan:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self.sorted_run(reduce(DataFrame.unionAll, self.levels[k]).repartition(*HASH)))
                self.levels[k] = []

    def state(self) -> DataFrame:
        """Of all batches: each hash with its documents and its largest doc_id."""
        return reduce(DataFrame.unionAll, [*self.runs(), *self.again]).groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))


def falling(found: DataFrame, batches: int) -> list[Column]:
    """Conditions that cut ids into `batches` ranges of about equal size, largest first; null ids are in the last one."""
    id_ = F.col("doc_id").cast("double")
    edges = sorted({*found.select(id_.alias("id")).approxQuantile("id", [b / batches for b in range(1, batches)], 0.02)}, reverse=True)
    above = [None, *edges]
    out = [(id_ >= lo) & (F.lit(True) if hi is None else id_ < hi) for hi, lo in zip(above, edges)]
    return [*out, F.col("doc_id").isNull() | ((id_ < edges[-1]) if edges else F.lit(True))]


def dedup_lines(docs: DataFrame, min_length: int = 40, min_docs: int = 5, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (struct of all input columns), doc_id, text (kept lines), n_lines, n_dropped for each input row."""
    source = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    lines = F.split("text", "\n")
    places = source.select("doc_id", "t", F.posexplode(lines).alias("place", "line")).select("doc_id", "t", "place", line_key(F.col("line")).alias("key"))
    found = settle(places.where(F.length("key") >= min_length).select("doc_id", "t", "place", hashed(F.col("key")).alias("h")).select("doc_id", "t", "place", "h.h1", "h.h2"))
    runs = SortedRuns()
    for part in falling(found, batches):
        runs.add(found.where(part).select("doc_id", *HASH).distinct().groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("top")))
    often = settle(runs.state().where(F.col("docs") >= min_docs))
    hot = F.broadcast(often.where(F.col("docs") * HOT >= found.count()).select(*HASH, "top"))
    usual = found.join(hot, [*HASH], "left_anti").join(often.select(*HASH, "top"), [*HASH])
    gone = found.join(hot, [*HASH]).unionByName(usual).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    dropped = gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("place")).alias("gone"))
    both = source.alias("d").join(dropped.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.t") == F.col("g.t")), "left")
    # What is kept lies between the places dropped: one slice from behind each (and from the start) up to the next (or the end).
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    between = F.arrays_zip(begins.alias("a"), F.concat("gone", F.array(F.col("n_lines").cast("int"))).alias("b"))
    # The lines are bound by a lambda of their own: a column named in the inner one would be split anew for each slice.
    kept = F.transform(F.array(lines), lambda all_: F.flatten(F.transform(between, lambda x: F.slice(all_, x["a"] + 1, x["b"] - x["a"]))))[0]
    cut = both.select("row", F.col("d.doc_id").alias("doc_id"), "text", "gone", F.size(lines).cast("long").alias("n_lines"))
    return cut.select("row", "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), "n_lines", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, (often.k IS NOT NULL AND keyed.doc_id <> often.top) AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
