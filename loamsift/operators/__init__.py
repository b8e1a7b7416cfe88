"""Operators on tables of file records."""
