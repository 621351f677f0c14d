"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from dpframe.llm import (collocations, decontaminate, html_extract, language, language_model, line_dedup, merkle, near_dedup, packing,
                         quality, suffix_dedup, token_store, url_rules)
from dpframe.llm.common import read


def op6_query(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dedup": near_dedup.op1_query,
    "op2_url_filter": url_rules.op2_query,
    "op3_lm_score": language_model.op3_query,
    "op4_html_text": html_extract.op4_query,
    "op5_quality_rules": quality.op5_query,
    "op6_best_fit_packing": op6_query,
    "op7_line_dedup": line_dedup.op7_query,
    "op8_decontamination": decontaminate.op8_query,
    "op9_language_id": language.op9_query,
    "op10_token_store": token_store.op10_query,
    "op11_suffix_dedup": suffix_dedup.op11_query,
    "op12_merkle_manifest": merkle.op12_query,
    "op13_collocations": collocations.op13_query,
}

ORACLES = {
    "op8_decontamination": decontaminate.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
