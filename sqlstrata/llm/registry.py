"""The operators' registered queries, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from sqlstrata.llm import decontaminate, divergence, jaccard_join, license_scan, main_text, packing, quality, repeat_index, secret_scan, toxicity, url_filter, vp_search, whitening

QUERIES = {
    "op1_harmonic_packing": packing.query,
    "op2_url_language_models": url_filter.query,
    "op3_benchmark_decontamination": decontaminate.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_secret_scan": secret_scan.query,
    "op6_vantage_point_search": vp_search.query,
    "op7_main_text": main_text.query,
    "op8_license_scan": license_scan.query,
    "op9_repeat_index": repeat_index.query,
    "op10_quality_cotraining": quality.query,
    "op11_embedding_whitening": whitening.query,
    "op12_toxicity_lexicon": toxicity.query,
    "op13_source_divergence": divergence.query,
}
ORACLES: dict[str, str] = {"op4_jaccard_join": jaccard_join.SQL, "op6_vantage_point_search": vp_search.SQL, "op8_license_scan": license_scan.SQL, "op13_source_divergence": divergence.SQL}
