"""Registered queries and the SQL they are checked against."""

from . import alerts, corpus, logs, streams  # noqa: F401  (they register their queries)
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
