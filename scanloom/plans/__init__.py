"""Derived inputs, whole pipelines and the registered queries."""
