"""Operators of a training-data pipeline, and their queries."""

from __future__ import annotations

from paceline.llm.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
