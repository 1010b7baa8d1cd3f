"""The queries of this subpackage, and SQL for those that SQL can express."""
from __future__ import annotations

from . import align, ann, chat, ctw, decontam, langid, licenses, mixing, quality, resample, simhash, tokenout, warc

QUERIES = {
    "op1_mixing": mixing.op1_query,
    "op2_nearest_neighbours": ann.op2_query,
    "op3_simhash_near_dedup": simhash.op3_query,
    "op4_chat_formatting": chat.op4_query,
    "op5_quality_classifier": quality.op5_query,
    "op6_context_tree_weighting": ctw.op6_query,
    "op7_decontamination": decontam.op7_query,
    "op8_token_output": tokenout.op8_query,
    "op9_license_scan": licenses.op9_query,
    "op10_language_id": langid.op10_query,
    "op11_warc": warc.op11_query,
    "op12_tokenizer_alignment": align.op12_query,
    "op13_importance_resampling": resample.op13_query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat_formatting": chat.OP4_SQL,
    "op11_warc": warc.OP11_SQL,
    "op13_importance_resampling": resample.OP13_SQL,
}
