"""The queries of this package and their SQL."""

from __future__ import annotations

from . import (
    bundles,
    hard_negatives,
    line_rules,
    mixing,
    packing,
    personal_data,
    quality_model,
    secret_scan,
    simhash,
    sketches,
    spelling,
    substring_dedup,
    suffix_dedup,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_line_rules": line_rules.query,
    "op3_bottom_k_sketches": sketches.query,
    "op4_secret_scan": secret_scan.query,
    "op5_suffix_array_dedup": suffix_dedup.query,
    "op6_warc_bundles": bundles.query,
    "op7_simhash": simhash.query,
    "op8_mixing": mixing.query,
    "op9_best_fit_packing": packing.query,
    "op10_quality_classifier": quality_model.query,
    "op11_personal_data": personal_data.query,
    "op12_spelling_variants": spelling.query,
    "op13_hard_negatives": hard_negatives.query,
}
#: The others are tested against brute force, round trips or held-out labels.
SQL = {"op2_line_rules": line_rules.SQL, "op6_warc_bundles": bundles.SQL, "op8_mixing": mixing.SQL, "op13_hard_negatives": hard_negatives.SQL}
