"""Token counts by heap-and-linked-list pair merging, without emitting identifiers.

A piece starts as one symbol per byte; the adjacent pair of lowest rank is popped from a heap and merged until none is
left, so its count is symbols minus merges. Documents stay where they are read: no shuffle. Memory is bounded by one
Arrow batch and a cache of at most bpe.KEPT_WORDS short pieces.

Null or empty text: 0 bytes, 0 tokens. Null ids and repeated rows pass through, one result row for each input row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.bpe import tokenizer_path, vocabulary
from weftline.llm.shared import ids_and_text, table


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs under the tokenizer file at path."""

    def counted(batches):
        words = vocabulary(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            tokens = [words.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
