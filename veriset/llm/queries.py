"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module that has ``query`` and, where SQL can express it, ``SQL``.
MODULES = {
    "op1_hnsw": "hnsw",
    "op2_license_scan": "license_scan",
    "op3_byte_shards": "sharding",
    "op4_token_records": "token_records",
    "op5_minhash": "minhash",
    "op6_toxicity": "toxicity",
    "op7_source_mix": "mixing",
    "op8_packing": "packing",
    "op9_line_dedup": "line_dedup",
    "op10_repetition": "repetition",
}

#: What SQL can check of operators that it cannot express: name -> module, its function and its SQL.
VIEWS = {
    "license_scan_base": ("license_scan", "base_query", "BASE_SQL"),
    "source_mix_targets": ("mixing", "targets_query", "TARGETS_SQL"),
    "repetition_base": ("repetition", "base_query", "BASE_SQL"),
}


def _lazy(module: str, function: str = "query") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f"veriset.llm.{module}"), function)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _lazy(module) for name, module in MODULES.items()} | {name: _lazy(module, function) for name, (module, function, _) in VIEWS.items()}


def oracle_sql() -> dict[str, str]:
    wanted = {name: (module, "SQL") for name, module in MODULES.items()} | {name: (module, sql) for name, (module, _, sql) in VIEWS.items()}
    found = {name: getattr(import_module(f"veriset.llm.{module}"), sql, None) for name, (module, sql) in wanted.items()}
    return {name: sql for name, sql in found.items() if sql}
