"""Reusable DataFrame operators: distributed global ranking, quality checks."""
