"""Queries of the operators for training-data pipelines, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, interaction_audit, itq_dedup, jaccard_join, language_id, license_scan, nearest_neighbours, packing, periodic_runs, secret_scan, substring_dedup, suffix_dedup, token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op5_nearest_neighbours": nearest_neighbours.op5_nearest_neighbours,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op9_language_id": language_id.op9_language_id,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op10_token_output": token_output.op10_token_output,
    "op11_itq_dedup": itq_dedup.op11_itq_dedup,
    "op12_interaction_audit": interaction_audit.op12_interaction_audit,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {"op6_secret_scan": secret_scan.ORACLE_SQL, "op12_interaction_audit": interaction_audit.ORACLE_SQL}
