"""Batch retrieval, routing, replay and evaluation over document corpora, as Spark jobs."""
