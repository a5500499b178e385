"""Operators and the pipeline for preparing training text; nothing else in the library imports this package."""
