"""The corpus queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (op1_jaccard, op2_bpe, op3_secrets, op4_sharding, op5_fingerprints, op6_toxicity, op7_lines,
               op8_tokens, op9_packing, op10_quality, op11_exact, op12_audit, op13_resampling)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_jaccard.query,
    "op2_byte_bpe": op2_bpe.query,
    "op3_secret_scans": op3_secrets.query,
    "op4_sharding": op4_sharding.query,
    "op5_document_fingerprints": op5_fingerprints.query,
    "op6_toxicity": op6_toxicity.query,
    "op7_line_dedup": op7_lines.query,
    "op8_token_counts": op8_tokens.query,
    "op9_best_fit_packing": op9_packing.query,
    "op10_quality_rules": op10_quality.query,
    "op11_exact_dedup": op11_exact.query,
    "op12_filter_audit": op12_audit.query,
    "op13_importance_resampling": op13_resampling.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_secret_scans": op3_secrets.ORACLE_SQL,
    "op4_sharding": op4_sharding.ORACLE_SQL,
    "op10_quality_rules": op10_quality.ORACLE_SQL,
    "op11_exact_dedup": op11_exact.ORACLE_SQL,
    "op12_filter_audit": op12_audit.ORACLE_SQL,
    "op13_importance_resampling": op13_resampling.ORACLE_SQL,
}
