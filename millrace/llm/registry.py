"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("licenses", "repeats", "decontaminate", "toxicity", "sharding", "hmm", "knn", "pii", "near_dedup", "mixing", "collocations", "rules", "alignment")
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f".{_name}", __package__)
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
