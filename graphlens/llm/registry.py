"""Queries of the corpus operators, and SQL where SQL expresses them."""

from __future__ import annotations

from graphlens.llm import ann, decontaminate, divergence, html, langid, line_dedup, mixing, pii, repair, secrets, simhash, suffixes, toxicity

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_mix": mixing.op2_mix,
    "op3_pii": pii.op3_pii,
    "op4_secrets": secrets.op4_secrets,
    "op5_ann": ann.op5_ann,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html": html.op9_html,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_repair": repair.op11_repair,
    "op12_suffixes": suffixes.op12_suffixes,
    "op13_divergence": divergence.op13_divergence,
}
SQL = mixing.SQL | decontaminate.SQL | line_dedup.SQL | suffixes.SQL | divergence.SQL
