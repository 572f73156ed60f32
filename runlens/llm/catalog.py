"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import (
    chat_format,
    decontaminate,
    language_id,
    ngram_join,
    period_runs,
    pii,
    quality_rules,
    secret_scan,
    sentencepiece_lattice,
    sharding,
    simhash,
    token_counts,
    whitening,
)

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_sharding": sharding.query,
    "op3_token_counts": token_counts.query,
    "op4_sentencepiece": sentencepiece_lattice.query,
    "op5_secret_scan": secret_scan.query,
    "op6_pii": pii.query,
    "op7_ngram_join": ngram_join.query,
    "op8_chat_format": chat_format.query,
    "op9_decontamination": decontaminate.query,
    "op10_quality_rules": quality_rules.query,
    "op11_period_runs": period_runs.query,
    "op12_whitening": whitening.query,
    "op13_simhash": simhash.query,
}

ORACLE = {
    "op5_secret_scan": secret_scan.ORACLE_SQL,
    "op8_chat_format": chat_format.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
}
