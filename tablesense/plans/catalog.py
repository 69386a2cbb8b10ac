"""Queries of the engine's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from tablesense.plans import q_answers, q_context, q_core, q_planning, q_profile, q_text

_PARTS = (q_core, q_profile, q_answers, q_text, q_planning, q_context)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
