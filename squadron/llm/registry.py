"""Queries of this subpackage and their SQL, for the entry module."""

from squadron.llm import decontamination, exact_dedup, language_id, license_scan, line_dedup, minhash_dedup, mixing, substring_dedup, token_output, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_token_output": token_output.op4_token_output,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_language_id": language_id.op8_language_id,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_minhash_dedup": minhash_dedup.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op7_license_scan": license_scan.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
