"""The queries of this subpackage and, where SQL expresses them, their DuckDB SQL."""

from __future__ import annotations

from . import chat, decontaminate, dominance, language, licenses, minhash, packing, pii, quality_rules, resampling, sharding, simhash, site_quality

MODULES = (licenses, chat, quality_rules, minhash, packing, decontaminate, language, pii, site_quality, sharding, resampling, dominance, simhash)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
