"""Operators for large text corpora; nothing outside this subpackage imports it.

`queries()` and `oracle_sql()` gather what the operators' modules register.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "fingerprint", "suffixdedup", "decontamination", "toxicity", "mixing", "urlfilter", "simhash", "linededup", "sharding")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"millrace.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"millrace.llm.{m}").SQL.items()}
