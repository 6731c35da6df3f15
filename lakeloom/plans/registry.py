"""All relational queries by name, each with its SQL for comparison where SQL has one."""

from lakeloom.plans import aggregates, corpus, extension, graphs, joins, scalars, streams, windows  # noqa: F401
from lakeloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
