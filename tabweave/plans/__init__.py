"""Measures, the semantic model and time intelligence."""
