"""Imports every module of queries, so that the registry is full."""

from folioflow.plans import document_queries, edit_queries, grid_queries, hierarchy_queries, record_queries, relational_queries, shape_queries, stream_queries, text_queries  # noqa: F401
from folioflow.plans.registry import ORACLES, QUERIES  # noqa: F401
