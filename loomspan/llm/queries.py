"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from loomspan.llm import exact_dedup, fingerprints, language_id, line_dedup, maintenance, mixing, negatives, sentencepiece_scan, simhash, suffix_dedup, toxicity, url_filter, warc

_MODULES = {
    "op1_suffix_dedup": suffix_dedup,
    "op2_warc": warc,
    "op3_sentencepiece": sentencepiece_scan,
    "op4_exact_dedup": exact_dedup,
    "op5_mixing": mixing,
    "op6_url_filter": url_filter,
    "op7_fingerprints": fingerprints,
    "op8_line_dedup": line_dedup,
    "op9_simhash": simhash,
    "op10_language_id": language_id,
    "op11_incremental_aggregates": maintenance,
    "op12_toxicity": toxicity,
    "op13_hard_negatives": negatives,
}
QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLE_SQL = {name: module.ORACLE_SQL for name, module in _MODULES.items() if module.ORACLE_SQL}
