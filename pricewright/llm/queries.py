"""The corpus queries: each operator over its whole table, and SQL where SQL can say it."""

from . import chat, extraction, licenses, merkle, minhash, mixing, neighbours, packing, pii, quality, repeats, spelling, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": repeats.op2_substring_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_chat_format": chat.op7_chat_format,
    "op8_minhash": minhash.op8_minhash,
    "op9_embedding_neighbours": neighbours.op9_embedding_neighbours,
    "op10_pii": pii.op10_pii,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_html_extraction": extraction.op12_html_extraction,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {
    "op4_mix_sources": mixing.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op8_minhash": minhash.OP8_SQL,
    "op10_pii": pii.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
