"""Secret scan with multipart credential linking, in DataFrame operations only.

Base findings are the leftmost non-overlapping matches of three patterns, with code-point offsets: matches and the gaps
between them come from one pattern each, and running sums of their lengths give the places. Weak candidates (an
upper-case identifier, a bare 40-character key, an endpoint address) are reported only where complementary parts stand
in their scope: within `reach` code points and not across a blank line. An identifier needs a secret, a key needs an
identifier, an endpoint needs both. The interval join of parts and scopes asks only for the nearest end before and the
nearest start behind of each role, so it is two ordered passes over a document's parts and never emits pairs.

Texts are read once and not shuffled; what is shuffled are lengths of matches and gaps, of documents that have matches.
All running sums and passes are windows over one document, in time linear in its matches but for sorting.

Null or empty text: no findings, empty strings. Null ids and repeated rows pass through, one result row for each row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.shared import ids_and_text, settle, table

KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Patterns by kind; those of access and hex ask for the least length at once, which finds the same maximal runs.
PATTERNS = {
    "assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}",
    "identifier": r"(?<![A-Za-z0-9])(?!AKIA)(?=[A-Z]*[0-9])[A-Z][A-Z0-9]{15,31}(?![A-Za-z0-9])", "key": r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", "endpoint": r"https?://[^\x00-\x20\"'<>]+",
}
SPANS = "array<struct<s:long,k:int,e:long>>"
BLANK = r"\n[ \t\r]*\n"


def steps_of(text: Column, kind: str) -> Column:
    """(k, i, gap, size, value) of each match in order, and of the gap behind the last one; empty without matches."""
    pattern, k = F.lit(PATTERNS[kind]), KINDS.index(kind)
    lengths = lambda column, name: F.transform(column, F.length).alias(name)
    value = lengths(F.regexp_extract_all(text, pattern, F.lit(2 if kind == "assign" else 0)), "value")
    steps = F.arrays_zip(lengths(F.split(text, PATTERNS[kind], -1), "gap"), lengths(F.regexp_extract_all(text, pattern, F.lit(0)), "size"), value)
    numbered = F.transform(steps, lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")))
    return F.when(text.rlike(PATTERNS[kind]), numbered).otherwise(F.array().cast("array<struct<k:int,i:int,gap:int,size:int,value:int>>"))


def joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, reach: int = 200, least: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, one array of spans for each base kind, and `linked`: weak candidates that complementary parts confirm.
    Values of assignments have `least` characters."""
    texts = ids_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    weak = reduce(Column.__or__, [text.rlike(PATTERNS[k]) for k in KINDS[3:]])
    blocks = F.arrays_zip(F.transform(F.split(text, BLANK, -1), F.length).alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(BLANK), F.lit(0)), F.length).alias("size"))
    found = settle(texts.select("doc_id", F.concat(*(steps_of(text, k) for k in KINDS)).alias("steps"), F.when(weak, blocks).alias("blocks")).withColumn("rid", F.monotonically_increasing_id()))
    length = F.sum(F.col("gap") + F.coalesce("size", F.lit(0)))
    steps = found.where(F.size("steps") > 0).select("rid", F.inline("steps")).repartition("rid")
    ended = steps.withColumn("e", length.over(W.partitionBy("rid", "k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    parts = ended.where(F.col("size").isNotNull() & ((F.col("k") > 0) | (F.col("value") >= least))).select("rid", (F.col("e") - F.col("size")).alias("s"), "k", "e")
    # A block's start is a part of its own kind (-1); the last one at or before a part names its block.
    pieces = found.where("blocks is not null").select("rid", F.posexplode("blocks").alias("i", "x")).select("rid", "i", "x.gap", "x.size").repartition("rid")
    starts = pieces.select("rid", F.coalesce(length.over(W.partitionBy("rid").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    candidates = parts.join(found.where("blocks is not null").select("rid"), "rid", "left_semi")
    marks = candidates.unionByName(starts.select("rid", "s", F.lit(-1).alias("k"), F.col("s").alias("e")))
    blocked = marks.withColumn("block", F.max(F.when(F.col("k") < 0, F.col("s"))).over(W.partitionBy("rid").orderBy("s", "k").rowsBetween(W.unboundedPreceding, 0))).where("k >= 0")
    role = {"id": F.col("k").isin(1, 3), "secret": F.col("k").isin(0, 2, 4), "base": F.col("k") < 3}
    # What stands behind is what stands before in the opposite order; a frame up to the end would be read anew for each row.
    scope = W.partitionBy("rid", "block")
    before = scope.orderBy("s", "k").rowsBetween(W.unboundedPreceding, -1)
    behind = scope.orderBy(F.desc("s"), F.desc("k")).rowsBetween(W.unboundedPreceding, -1)
    near = blocked.select("*", *(F.max(F.when(is_role, F.col("e"))).over(before).alias(f"{name}_end") for name, is_role in role.items()))
    near = near.select("*", *(F.min(F.when(is_role, F.col("s"))).over(behind).alias(f"{name}_start") for name, is_role in role.items()))
    within = lambda name, d: F.coalesce(F.col("s") - F.col(f"{name}_end") < d, F.lit(False)) | F.coalesce(F.col(f"{name}_start") - F.col("e") < d, F.lit(False))
    confirmed = near.where("k >= 3").where(~within("base", 0)).where(F.when(F.col("k") == 3, within("secret", reach)).when(F.col("k") == 4, within("id", reach)).otherwise(within("id", reach) & within("secret", reach)))
    span = F.struct("s", "k", "e")
    chosen = parts.where("k < 3").unionByName(confirmed.select("rid", "s", "k", "e"))
    named = {**{kind: F.col("k") == k for k, kind in enumerate(KINDS[:3])}, "linked": F.col("k") >= 3}
    spans = chosen.groupBy("rid").agg(*(F.sort_array(F.collect_list(F.when(own, span))).alias(name) for name, own in named.items()))
    return found.select("doc_id", "rid").join(spans, "rid", "left").select("doc_id", *(F.coalesce(name, F.array().cast(SPANS)).alias(name) for name in named))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(*KINDS[:3])
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.concat(base, "linked")).alias("spans")
    )
