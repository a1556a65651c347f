"""Queries that apply the library's jobs to the driver's tables, and the SQL that checks them."""

from terrajobs.plans import queries_flow, queries_graph, queries_scalar, queries_shape  # noqa: F401
from terrajobs.plans.registry import ORACLES, QUERIES  # noqa: F401
