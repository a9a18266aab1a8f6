"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

#: query name -> (module, attribute)
NAMES = {
    "op1_licenses": "licenses",
    "op2_exact_dedup": "exact_dedup",
    "op3_decontaminate": "decontaminate",
    "op4_secrets": "secrets",
    "op5_chat_quotes": "chat_quotes",
    "op6_simhash": "simhash",
    "op7_pii": "pii",
    "op8_binary_output": "binary_output",
    "op9_packing": "packing",
    "op10_quality": "quality",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in NAMES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in NAMES.items()}
    return {name: sql for name, sql in found.items() if sql}
