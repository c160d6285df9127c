"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from leadspark.llm import op1_secrets, op2_suffix_array, op3_line_dedup, op4_decontaminate, op5_sentencepiece, op6_ngram_join, op7_lm, op8_token_tables, op9_quality, op10_automaton, op11_repair, op12_tensored, op13_runs

MODULES = [op1_secrets, op2_suffix_array, op3_line_dedup, op4_decontaminate, op5_sentencepiece, op6_ngram_join, op7_lm, op8_token_tables, op9_quality, op10_automaton, op11_repair, op12_tensored, op13_runs]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
