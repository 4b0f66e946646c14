"""Queries and DuckDB SQL of the training-data operators, by name."""

from . import byte_bpe, exact_dedup, hard_negatives, language_id, media, near_dedup, packing, pii, source_audit, substring_dedup, topk, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        warc.op1_warc,
        topk.op2_topk,
        packing.op3_packing,
        substring_dedup.op4_substring_dedup,
        language_id.op5_language_id,
        toxicity.op6_toxicity,
        byte_bpe.op7_byte_bpe,
        pii.op8_pii,
        media.op9_media,
        near_dedup.op10_near_dedup,
        exact_dedup.op11_exact_dedup,
        hard_negatives.op12_hard_negatives,
        source_audit.op13_source_audit,
    )
}
ORACLES = {"op1_warc": warc.ORACLE, "op2_topk": topk.ORACLE, "op4_substring_dedup": substring_dedup.ORACLE, "op10_near_dedup": near_dedup.ORACLE, "op11_exact_dedup": exact_dedup.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_source_audit": source_audit.ORACLE}
