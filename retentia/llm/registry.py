"""Queries of the corpus operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, decontamination, language, minhash, neighbours, packing, quality, secrets, sharding, sql, substring, suffix_array, toxicity, whitening

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_toxicity": toxicity.query,
    "op3_suffix_array_dedup": suffix_array.query,
    "op4_substring_dedup": substring.query,
    "op5_sharding": sharding.query,
    "op6_nearest_neighbours": neighbours.query,
    "op7_minhash_near_dedup": minhash.query,
    "op8_quality": quality.query,
    "op9_packing": packing.query,
    "op10_language_id": language.query,
    "op11_whitening": whitening.query,
    "op12_secret_scan": secrets.query,
    "op13_token_alignment": alignment.query,
}
ORACLE_SQL: dict[str, str] = {
    "op3_suffix_array_dedup": sql.REPEATED_BYTES,
    "op4_substring_dedup": sql.REPEATED_WORDS,
    "op5_sharding": sql.SHARDS,
    "op7_minhash_near_dedup": sql.NEAR_DUPLICATES,
    "op12_secret_scan": sql.secret_spans(secrets.RULES, len(secrets.BASE_RULES)),
}
