"""Queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: module of this subpackage; the function has the query's name.
NAMES = {
    "op1_sharding": "sharding",
    "op2_packing": "packing",
    "op3_mixing": "mixing",
    "op4_pii": "pii",
    "op5_llr_quality": "llr_quality",
    "op6_posting_lists": "ann",
    "op7_simhash": "simhash",
    "op8_substrings": "substrings",
    "op9_quality_gam": "quality_gam",
    "op10_toxicity_svm": "toxicity",
    "op11_merkle": "merkle",
    "op12_tiered_search": "tiered",
    "op13_sentencepiece": "pieces",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in NAMES.items():
        if sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None):
            found[name] = sql
    return found
