"""Queries of the corpus operators, by name, with oracles where SQL can express them."""

from __future__ import annotations

from lathework.llm import (
    compaction,
    decontamination,
    near_dedup,
    order_minhash,
    packing,
    quality,
    secret_scan,
    substring_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    f.__name__: f
    for f in (
        decontamination.op1_decontamination,
        quality.op2_quality,
        compaction.op3_compaction,
        packing.op4_best_fit_packing,
        order_minhash.op5_fingerprints,
        secret_scan.op6_secret_scan,
        substring_dedup.op7_substring_dedup,
        token_counts.op8_token_counts,
        near_dedup.op9_near_dedup,
        toxicity.op10_toxicity,
    )
}
ORACLES = {"op7_substring_dedup": substring_dedup.ORACLE}
