"""The pN_ queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import canonical, mixing, neardup, quality, shared, survivor, terms, tokens

_MODULES = [neardup, survivor, terms, canonical, shared, tokens, mixing, quality]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
