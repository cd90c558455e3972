"""The corpus operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chatformat, decontaminate, jaccard, langid, licenses, linededup, packing, pii, quality, suffix

_OPS = {
    "op1_license_scan": licenses,
    "op2_pii_crf": pii,
    "op3_quality_rules": quality,
    "op4_line_dedup": linededup,
    "op5_best_fit_packing": packing,
    "op6_suffix_array_dedup": suffix,
    "op7_ngram_jaccard_join": jaccard,
    "op8_language_id": langid,
    "op9_benchmark_decontamination": decontaminate,
    "op10_chat_format": chatformat,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: op.query for name, op in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: op.ORACLE_SQL for name, op in _OPS.items() if getattr(op, "ORACLE_SQL", None)}
