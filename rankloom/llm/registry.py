"""The corpus operators' registered queries and their SQL twins."""

from __future__ import annotations

from rankloom.llm import (
    decontaminate,
    edits,
    filteraudit,
    fim,
    langid,
    licenses,
    linededup,
    packing,
    pii,
    quality,
    secretscan,
    simhash,
    warc,
)

QUERIES = {
    "op1_surrogates": pii.op1_surrogates,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_warc": warc.op4_warc,
    "op5_licenses": licenses.op5_licenses,
    "op6_language": langid.op6_language,
    "op7_token_counts": edits.op7_token_counts,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_quality": quality.op9_quality,
    "op10_packing": packing.op10_packing,
    "op11_filter_audit": filteraudit.op11_filter_audit,
    "op12_secrets": secretscan.op12_secrets,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op2_line_dedup": linededup.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_licenses": licenses.OP5_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op11_filter_audit": filteraudit.OP11_SQL,
    "op12_secrets": secretscan.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
