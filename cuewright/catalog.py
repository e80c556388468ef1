"""Every query of the engine by name, with the SQL that states the same result."""

from __future__ import annotations

from .plans import blocks, joins, speech, studio, timeline

_PLANS = (timeline, blocks, joins, speech, studio)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE = {name: sql for plan in _PLANS for name, sql in plan.ORACLE.items()}
