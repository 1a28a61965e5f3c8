"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from marlstone.llm import chat, htmltext, knn, licenses, mixing, packing, pii, quality, resampling, secrets, simhash, warc, whitening


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_chat": chat.op2_chat,
        "op3_simhash": simhash.op3_simhash,
        "op4_packing": packing.op4_packing,
        "op5_html": htmltext.op5_html,
        "op6_warc": warc.op6_warc,
        "op7_quality": quality.op7_quality,
        "op8_mixing": mixing.op8_mixing,
        "op9_secrets": secrets.op9_secrets,
        "op10_topk": knn.op10_topk,
        "op11_resample": resampling.op11_resample,
        "op12_whitening": whitening.op12_whitening,
        "op13_licenses": licenses.op13_licenses,
    }


def oracle_sql() -> dict:
    return {"op2_chat": chat.ORACLE, "op6_warc": warc.ORACLE, "op10_topk": knn.ORACLE, "op11_resample": resampling.ORACLE}
