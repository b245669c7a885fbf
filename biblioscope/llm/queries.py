"""The registered queries of this subpackage; SQL is given where it can express the operator."""

from __future__ import annotations

from . import decontaminate, langid, licenses, near_dedup, packing, pii, suffix_dedup, token_counts, toxicity, webp

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_language_id": langid.query,
    "op3_decontamination": decontaminate.query,
    "op4_webp_media": webp.query,
    "op5_license_scan": licenses.query,
    "op6_token_counts": token_counts.query,
    "op7_toxicity": toxicity.query,
    "op8_pii": pii.query,
    "op9_near_duplicates": near_dedup.query,
    "op10_best_fit_packing": packing.query,
}
ORACLE_SQL: dict[str, str] = {}
