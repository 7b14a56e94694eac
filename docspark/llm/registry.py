"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

from docspark.llm import decontaminate, licenses, mixing, neardup, quality, sharding, substrings, tokens, warc
from docspark.session import importable


def ready(query):
    return lambda spark, sf_dir: query(importable(spark), sf_dir)


def queries() -> dict:
    found = {
        "op1_minhash_near_dedup": neardup.op1_minhash_near_dedup,
        "op2_mixing": mixing.op2_mixing,
        "op3_token_binary": tokens.op3_token_binary,
        "op4_token_counts": tokens.op4_token_counts,
        "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_warc": warc.op8_warc,
        "op9_substring_dedup": substrings.op9_substring_dedup,
        "op10_sharding": sharding.op10_sharding,
    }
    return {name: ready(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": neardup.OP1_SQL,
        "op2_mixing": mixing.OP2_SQL,
        "op5_benchmark_decontamination": decontaminate.OP5_SQL,
        "op6_license_scan": licenses.OP6_SQL,
        "op7_quality_rules": quality.OP7_SQL,
        "op8_warc": warc.OP8_SQL,
    }
