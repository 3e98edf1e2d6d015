"""The corpus queries and, where SQL expresses them, their SQL."""

from __future__ import annotations

from . import decontaminate, divergence, embedding_dedup, html_text, licenses, minhash, packing, quality, spelling, substring_dedup, toxicity, url_filter, warc

_QUERIES = {
    "op1_warc_revisits": (warc.op1_warc_revisits, warc.ORACLE_SQL),
    "op2_decontamination": (decontaminate.op2_decontamination, decontaminate.ORACLE_SQL),
    "op3_toxicity": (toxicity.op3_toxicity, None),
    "op4_html_text": (html_text.op4_html_text, None),
    "op5_url_filter": (url_filter.op5_url_filter, url_filter.ORACLE_SQL),
    "op6_substring_dedup": (substring_dedup.op6_substring_dedup, None),
    "op7_packing": (packing.op7_packing, None),
    "op8_quality": (quality.op8_quality, None),
    "op9_minhash_dedup": (minhash.op9_minhash_dedup, minhash.ORACLE_SQL),
    "op10_embedding_dedup": (embedding_dedup.op10_embedding_dedup, embedding_dedup.ORACLE_SQL),
    "op11_license_scan": (licenses.op11_license_scan, licenses.ORACLE_SQL),
    "op12_source_divergence": (divergence.op12_source_divergence, divergence.ORACLE_SQL),
    "op13_spelling_variants": (spelling.op13_spelling_variants, None),
}


def queries() -> dict:
    return {name: query for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
