"""Readers and writers for the curated tables."""
