"""Queries and pipelines made of operators."""
