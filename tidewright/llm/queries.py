"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, html, linededup, packing, periodic, pii, quality, sharding, simhash, sketch, substring, tokencount, whitening

QUERIES = {
    "op1_token_counts": tokencount.op1_token_counts,
    "op2_quality": quality.op2_quality,
    "op3_html": html.op3_html,
    "op4_simhash": simhash.op4_simhash,
    "op5_pii": pii.op5_pii,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_packing": packing.op8_packing,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_sketch": sketch.op11_sketch,
    "op12_whitening": whitening.op12_whitening,
    "op13_periodic_runs": periodic.op13_periodic_runs,
    "quality_ablation": quality.quality_ablation,
    "quality_policies": quality.quality_policies,
}
ORACLES = {
    "op2_quality": quality.SQL,
    "op7_decontamination": decontaminate.SQL,
    "op9_line_dedup": linededup.SQL,
    "op11_sketch": sketch.SQL,
    "quality_ablation": quality.ABLATION_SQL,
    "quality_policies": quality.POLICIES_SQL,
}
