"""Imports every module that registers queries."""
from skarn.plans import queries_index, queries_ingest, queries_model, queries_more, queries_project, queries_search, queries_state, queries_sweep  # noqa: F401
