"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from weftline.llm.op1_jaccard_join import op1_jaccard_join
from weftline.llm.op2_decontamination import op2_decontamination
from weftline.llm.op3_repeated_bytes import op3_repeated_bytes
from weftline.llm.op4_secret_scan import op4_secret_scan
from weftline.llm.op5_warc import op5_warc
from weftline.llm.op6_line_dedup import SQL as LINES_SQL
from weftline.llm.op6_line_dedup import op6_line_dedup
from weftline.llm.op7_quality import op7_quality
from weftline.llm.op8_token_counts import op8_token_counts
from weftline.llm.op9_hash_forest import op9_hash_forest
from weftline.llm.op10_packing import op10_packing
from weftline.llm.sql import JACCARD, WARC

QUERIES = {
    f.__name__: f
    for f in (op1_jaccard_join, op2_decontamination, op3_repeated_bytes, op4_secret_scan, op5_warc, op6_line_dedup, op7_quality, op8_token_counts, op9_hash_forest, op10_packing)
}
ORACLE_SQL: dict[str, str] = {"op1_jaccard_join": JACCARD, "op5_warc": WARC, "op6_line_dedup": LINES_SQL}
