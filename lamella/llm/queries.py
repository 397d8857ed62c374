"""The numbered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from lamella.llm import collocations, decontaminate, divergence, embedding_dedup, licenses, line_dedup, merkle, mixing, near_dedup, quality, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_sharding": sharding.op4_sharding,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_divergence": divergence.op12_divergence,
    "op13_merkle": merkle.op13_merkle,
}
ORACLE_SQL = {
    "op5_license_scan": licenses.ORACLE_SQL,
    "op6_near_dedup": near_dedup.ORACLE_SQL,
    "op8_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op9_decontamination": decontaminate.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_divergence": divergence.ORACLE_SQL,
    "op13_merkle": merkle.ORACLE_SQL,
}
