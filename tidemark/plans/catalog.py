"""Imports every query module, so that all queries are registered."""

from tidemark.plans import evaluating, live, records, replaying, retrieval, serving, text_prep  # noqa: F401
