"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import chat, decontaminate, licenses, lm, packing, quality, repair, secrets, simhash, tokens, toxicity, urls, vectors

MODULES = [chat, decontaminate, licenses, lm, packing, quality, repair, secrets, simhash, tokens, toxicity, urls, vectors]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
