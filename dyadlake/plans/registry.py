"""The registered queries of the relational operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from dyadlake.sources.tables import ACTIONS, HANDS, PAIRS, SEATED, SEATS

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
_RELATIONS = {"hands": HANDS, "seats": SEATS, "seated": SEATED, "pairs": PAIRS, "actions": ACTIONS}
_NEEDS = {"seated": ("seats", "hands"), "pairs": ("seats", "hands")}


def query(sql: str | None = None, *relations: str, also: str = "") -> Callable:
    """Registers a function (spark, sf_dir) under its name, with DuckDB SQL over the base tables and the named relations.

    ``also``: further common table expressions, put after the relations.
    """

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            needed = [n for r in relations for n in (*_NEEDS.get(r, ()), r)]
            parts = [_RELATIONS[n] for n in dict.fromkeys(needed)] + ([also] if also else [])
            ORACLE_SQL[f.__name__] = (f"WITH {', '.join(parts)} " if parts else "") + sql
        return f

    return register
