"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from chronolake.llm import decontamination, exact_dedup, jaccard_join, license_scan, mixing, quality, sharding, substring_dedup, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op7_quality": quality.op7_quality,
    "op5_token_files": token_files.op5_token_files,
    "op6_reshard": sharding.op6_reshard,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_decontaminate": decontamination.op9_decontaminate,
    "op10_license_scan": license_scan.op10_license_scan,
}
ORACLE_SQL = {
    "op2_jaccard_join": jaccard_join.ORACLE_SQL,
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_mix_sources": mixing.ORACLE_SQL,
    "op10_license_scan": license_scan.ORACLE_SQL,
}
