"""From raw documents to packed training windows: quality, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents,
the last one the pieces of windows. run() writes every stage's result under the shared checkpoint folder and rereads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bpe import tokenizer_path
from weftline.llm.op1_jaccard_join import jaccard_groups
from weftline.llm.op2_decontamination import decontaminate
from weftline.llm.op6_line_dedup import dedup_lines
from weftline.llm.op7_quality import fit_quality, score_quality
from weftline.llm.op10_packing import pack
from weftline.llm.shared import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade reaches the cut."""
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).where("keep").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without long lines that at least five hold; the largest doc_id keeps them."""
    done = dedup_lines(docs)
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("text")).otherwise(F.col("row.text")), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars"))}
    return done.select(*(changed[c].cast(t).alias(c) if c in changed else F.col(f"row.`{c}`") for c, t in docs.dtypes))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of five-word shingle similarity 0.8; rows without an id stay."""
    groups = jaccard_groups(docs, words=5, num=80, den=100)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokenization and a fitted model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
