"""Composed plans (multi-operator pipelines) and the query registry."""
