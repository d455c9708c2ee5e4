"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from plumbline.llm import ctw, decontaminate, dual_tree, language_id, line_dedup, media_columns, merkle, mixing, secret_scan, simhash, token_output, url_filter, wrapper

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_token_output": token_output.op5_token_output,
    "op6_mixing": mixing.op6_mixing,
    "op7_simhash": simhash.op7_simhash,
    "op8_language_id": language_id.op8_language_id,
    "op9_media_columns": media_columns.op9_media_columns,
    "op10_ctw": ctw.op10_ctw,
    "op11_dual_tree": dual_tree.op11_dual_tree,
    "op12_wrapper": wrapper.op12_wrapper,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_secret_scan": secret_scan.OP4_SQL,
    "op11_dual_tree": dual_tree.OP11_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
