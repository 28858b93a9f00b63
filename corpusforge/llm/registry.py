"""Queries and SQL of this subpackage, by name."""

from corpusforge.llm import bpe, exact_dedup, hard_negatives, jaccard_join, langid, line_dedup, mixing, near_dedup, quality, source_audit, suffix_dedup, topk_search, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_topk_search": topk_search.op3_topk_search,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_language_id": langid.op6_language_id,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_warc": warc.op8_warc,
    "op9_quality": quality.op9_quality,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_jaccard_join": jaccard_join.op13_jaccard_join,
}
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op3_topk_search": topk_search.OP3_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op7_near_dedup": near_dedup.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_source_audit": source_audit.OP12_SQL,
    "op13_jaccard_join": jaccard_join.OP13_SQL,
}
