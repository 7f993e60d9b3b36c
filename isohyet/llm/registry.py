"""Queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op01_quality, op02_decontaminate, op03_html, op04_pii, op05_packing, op06_sharding, op07_toxicity, op08_language_model, op09_simhash, op10_licenses, op11_spelling, op12_language_id, op13_hard_negatives

QUERIES = {
    "op1_quality_rules": op01_quality.op1_quality_rules,
    "op2_prefix_filter": op02_decontaminate.op2_prefix_filter,
    "op3_tag_path_ratios": op03_html.op3_tag_path_ratios,
    "op4_pii_spans": op04_pii.op4_pii_spans,
    "op5_cost_balanced": op05_packing.op5_cost_balanced,
    "op6_prefix_shards": op06_sharding.op6_prefix_shards,
    "op7_noisy_or": op07_toxicity.op7_noisy_or,
    "op8_elias_fano_lm": op08_language_model.op8_elias_fano_lm,
    "op9_simhash_mih": op09_simhash.op9_simhash_mih,
    "op10_license_digests": op10_licenses.op10_license_digests,
    "op11_spelling_variants": op11_spelling.op11_spelling_variants,
    "op12_bloom_language_id": op12_language_id.op12_bloom_language_id,
    "op13_distance_keys": op13_hard_negatives.op13_distance_keys,
}
ORACLES = {"op2_prefix_filter": op02_decontaminate.ORACLE, "op10_license_digests": op10_licenses.oracle(), "op13_distance_keys": op13_hard_negatives.ORACLE}
