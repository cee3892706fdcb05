"""Queries of the text operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, html_text, language, near_dups, packed_ids, packing, passages, periodic, quality, resampling, rules, secrets, urls

QUERIES = {
    "op1_passages": passages.op1_passages,
    "op2_quality": quality.op2_quality,
    "op3_best_fit": packing.op3_best_fit,
    "op4_language": language.op4_language,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_rules": rules.op6_rules,
    "op7_near_duplicates": near_dups.op7_near_duplicates,
    "op8_token_files": packed_ids.op8_token_files,
    "op9_urls": urls.op9_urls,
    "op10_secrets": secrets.op10_secrets,
    "op11_resampling": resampling.op11_resampling,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_html_text": html_text.op13_html_text,
}

ORACLE_SQL = {
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op6_rules": rules.ORACLE_SQL,
    "op9_urls": urls.ORACLE_SQL,
}
