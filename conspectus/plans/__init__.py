"""Registered queries of the concept index, and the same queries in SQL."""

from . import graphs, language, lookups, mining, relational, resolving, searching, storing, textual

MODULES = (relational, textual, language, graphs, searching, resolving, mining, storing, lookups)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.S.items() if s}
