"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from quadweave.llm import byte_bpe, fingerprints, line_dedup, near_dedup, packing, quality_neighbours, quality_rules, secrets, substring_dedup, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_quality_rules": quality_rules.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_secret_scans": secrets.query,
    "op5_fingerprints": fingerprints.query,
    "op6_toxicity": toxicity.query,
    "op7_byte_bpe": byte_bpe.query,
    "op8_quality_neighbours": quality_neighbours.query,
    "op9_packing": packing.query,
    "op10_line_dedup": line_dedup.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_near_dedup": near_dedup.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE.replace("{documents}", "documents"),
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
