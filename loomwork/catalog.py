"""Registered queries and their SQL, by id."""

from __future__ import annotations

from loomwork.queries import basic, modelling, relational  # noqa: F401
from loomwork.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
