"""All plan modules, which register their queries when they are imported. Nothing but the entry point and tests needs this module: each plan module can be imported by itself."""

from dyadlake.plans import aggregates, anatomy, basics, behaviour, boosted, cards, extras, interactions, learning, levels, ranking, selection, streams, wide, windows  # noqa: F401
from dyadlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
