"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from gridloom.llm import chat_format, decontamination, license_scan, line_dedup, lm_scoring, ngram_join, periodic_runs, quality, source_mixing, token_output, vector_codes, vector_dedup, warc

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_vector_dedup": vector_dedup.op4_vector_dedup,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_source_mixing": source_mixing.op6_source_mixing,
    "op7_quality": quality.op7_quality,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_token_output": token_output.op10_token_output,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_warc": warc.op12_warc,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op4_vector_dedup": vector_dedup.OP4_SQL,
    "op8_license_scan": license_scan.OP8_SQL,
    "op9_decontamination": decontamination.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_warc": warc.OP12_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
