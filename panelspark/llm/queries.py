"""Driver queries of the training-data operators, in the order dealt."""

from __future__ import annotations

from panelspark.llm import (
    collocations,
    decontaminate,
    embedding_dedup,
    license_scan,
    quality,
    quality_rules,
    resharding,
    secret_scan,
    simhash_dedup,
    source_divergence,
    sp_sampling,
    suffix_dedup,
    url_filter,
)


def queries() -> dict:
    return {
        "op1_quality_classifier": quality.op1,
        "op2_url_filters": url_filter.op2,
        "op3_suffix_array_dedup": suffix_dedup.op3,
        "op4_sentencepiece_sampling": sp_sampling.op4,
        "op5_sharding": resharding.op5,
        "op6_secret_scans": secret_scan.op6,
        "op7_license_scans": license_scan.op7,
        "op8_benchmark_decontamination": decontaminate.op8,
        "op9_simhash_near_dedup": simhash_dedup.op9,
        "op10_embedding_near_dedup": embedding_dedup.op10,
        "op11_quality_rules": quality_rules.op11,
        "op12_source_divergence": source_divergence.op12,
        "op13_phrase_collocations": collocations.op13,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can state the whole result; tests hold the others against brute force."""
    return {
        "op3_suffix_array_dedup": suffix_dedup.OP3_SQL,
        "op7_license_scans": license_scan.OP7_SQL,
        "op8_benchmark_decontamination": decontaminate.OP8_SQL,
        "op10_embedding_near_dedup": embedding_dedup.OP10_SQL,
        "op11_quality_rules": quality_rules.OP11_SQL,
        "op12_source_divergence": source_divergence.OP12_SQL,
        "op13_phrase_collocations": collocations.OP13_SQL,
    }
