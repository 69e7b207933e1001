"""The queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import bpe, langid, oracles, packing, quality, secrets, simhash, suffix_sort, suffix_tree, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": suffix_sort.op1_suffix_array,
    "op2_warc": warc.op2_warc,
    "op3_language_id": langid.op3_language_id,
    "op4_simhash": simhash.op4_simhash,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_packing": packing.op8_packing,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_suffix_tree": suffix_tree.op10_suffix_tree,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array": oracles.OP1_SQL,
    "op2_warc": oracles.OP2_SQL,
    "op4_simhash": oracles.OP4_SQL,
    "op5_exact_topk": topk.OP5_SQL,
    "op10_suffix_tree": oracles.OP10_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
