"""The subpackage's queries, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, divergence, fill_middle, language, media, mixing, pii, sharding, simhash, substring_dedup, suffix_dedup, token_files, toxicity

_QUERIES = [suffix_dedup.op1_suffix_array_dedup, language.op2_language_id, substring_dedup.op3_substring_dedup, simhash.op4_simhash_near_dedup, sharding.op5_sharding, media.op6_media_columns, mixing.op7_mixing_sources, decontaminate.op8_benchmark_decontamination, toxicity.op9_toxicity, pii.op10_pii, divergence.op11_source_divergence, token_files.op12_token_files, fill_middle.op13_fill_in_middle]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_sharding": sharding.oracle_sql(), "op7_mixing_sources": mixing.ORACLE_SQL, "op8_benchmark_decontamination": decontaminate.ORACLE_SQL, "op11_source_divergence": divergence.ORACLE_SQL, "op13_fill_in_middle": fill_middle.ORACLE_SQL}
