"""Registered queries: each Spark query with the SQL that must give the same rows."""

from queries import anchors, evaluation, features, history, joins, replay, scalars, sources  # noqa: F401
from queries.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
