"""Compositions of operators that make up whole analyses."""
