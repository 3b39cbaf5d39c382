"""Cohort and profile analytics as Spark jobs."""
