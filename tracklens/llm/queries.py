"""The text operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontamination, extraction, jaccard, licenses, packing, quality_classifier, quality_rules, resampling, spelling, substrings, tokens, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_best_fit_packing": packing.op2,
        "op3_license_scan": licenses.op3,
        "op4_quality_rules": quality_rules.op4,
        "op5_substring_dedup": substrings.op5,
        "op6_url_filter": url_filter.op6,
        "op7_decontamination": decontamination.op7,
        "op8_token_ids": tokens.op8,
        "op9_ngram_jaccard": jaccard.op9,
        "op10_quality_classifier": quality_classifier.op10,
        "op11_html_extraction": extraction.op11,
        "op12_spelling_variants": spelling.op12,
        "op13_importance_resampling": resampling.op13,
        "license_base_columns": licenses.base_columns,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "license_base_columns": licenses.BASE_SQL,
        "op4_quality_rules": quality_rules.SQL,
        "op5_substring_dedup": substrings.SQL,
        "op6_url_filter": url_filter.SQL,
        "op7_decontamination": decontamination.SQL,
        "op9_ngram_jaccard": jaccard.SQL,
        "op11_html_extraction": extraction.SQL,
        "op12_spelling_variants": spelling.SQL,
        "op13_importance_resampling": resampling.SQL,
    }
