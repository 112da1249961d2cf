"""Queries of the ride engine by name, with SQL that states the same."""

from __future__ import annotations

from paceline.plans import importing, keeping, live, pace, routes, scanning, streams, upkeep

_MODULES = (pace, routes, keeping, live, importing, scanning, upkeep, streams)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
