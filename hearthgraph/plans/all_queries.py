"""Importing the modules registers their queries."""

from hearthgraph.plans import q_functions, q_jobs, q_joins, q_linkage, q_more, q_search, q_tables, q_workflow  # noqa: F401
