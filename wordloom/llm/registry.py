"""Queries and oracle SQL of this subpackage, by name."""

from . import alignment, decontamination, exact_dedup, extraction, fim, language, line_dedup, mixing, quality, sharding, simhash, tokenids, warc

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_mixing": mixing.op2_mixing,
    "op3_extraction": extraction.op3_extraction,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_warc": warc.op6_warc,
    "op7_sharding": sharding.op7_sharding,
    "op8_token_ids": tokenids.op8_token_ids,
    "op9_quality": quality.op9_quality,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_fim": fim.op11_fim,
    "op12_alignment": alignment.op12_alignment,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}

ORACLES = {
    "op2_mixing": mixing.SQL,
    "op5_decontamination": decontamination.SQL,
    "op6_warc": warc.SQL,
    "op9_quality": quality.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_fim": fim.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
