"""The queries of this subpackage, by name, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from . import fingerprints, language, line_dedup, media, mixing, near_dups, packing, pii, suffix_dedup, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_pii": pii.query,
    "op3_fingerprints": fingerprints.query,
    "op4_toxicity": toxicity.query,
    "op5_media": media.query,
    "op6_packing": packing.query,
    "op7_language": language.query,
    "op8_mixing": mixing.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_near_dups": near_dups.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op3_fingerprints": fingerprints.ORACLE_SQL,
}
