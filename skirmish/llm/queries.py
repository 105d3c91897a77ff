"""The operators' queries over their whole tables, with production parameters, and SQL for those that SQL can express."""
from __future__ import annotations

from skirmish.llm import byte_bpe, html_extract, near_dedup, nearest, packing, quality_classifier, quality_rules, substring_dedup, toxicity, warc

QUERIES = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_quality_rules": quality_rules.query,
    "op3_nearest": nearest.query,
    "op4_html_extract": html_extract.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_packing": packing.query,
    "op7_toxicity": toxicity.query,
    "op8_warc": warc.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_near_dedup": near_dedup.query,
}
ORACLES = {
    "op5_substring_dedup": substring_dedup.SQL,
    "op8_warc": warc.SQL,
    "op10_near_dedup": near_dedup.SQL,
}
