"""Cleaning of a training corpus in stages."""

from rekindle.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
