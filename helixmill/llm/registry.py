"""Queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

from helixmill.llm import alignment, bpe_tree, decontaminate, hard_negatives, jaccard_join, line_dedup, pii, quality_gam, quality_rules, sentencepiece_viterbi, sharding, substring_dedup, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_hilbert_sharding": sharding.op4_hilbert,
    "op5_pii": pii.op5_pii,
    "op6_sentencepiece": sentencepiece_viterbi.op6_sentencepiece,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_quality_gam": quality_gam.op8_quality_gam,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_warc": warc.op10_warc,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_bpe_tree": bpe_tree.op12_bpe_tree,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL: dict[str, str] = {**decontaminate.SQL, **substring_dedup.SQL, **jaccard_join.SQL, **line_dedup.SQL, **warc.SQL, **hard_negatives.SQL}
