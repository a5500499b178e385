"""Readers and writers for the text formats of the field, on Spark file sources."""
