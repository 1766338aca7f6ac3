"""Registered queries: each operator on the driver tables, with its SQL counterpart."""

from fitlake.queries.registry import QUERIES, SQL, load_all

__all__ = ["QUERIES", "SQL", "load_all"]
