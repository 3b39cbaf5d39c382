"""Readers and writers; all through Spark's own sources, so any store that Spark reads will do."""
