"""Readers of staged tables, reference tables, and writers of published tables."""
