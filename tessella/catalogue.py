"""Every registered query of the library itself, with its SQL."""

from __future__ import annotations

from .plans import catalogues, imaging, learning, modelling, objects, regions, relational, samples, sources, spatial, statistics

_PLANS = (spatial, statistics, relational, learning, imaging, modelling, sources, objects, samples, regions, catalogues)
QUERIES = {name: fn for plan in _PLANS for name, fn in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
