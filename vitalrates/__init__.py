"""Cohort survival analytics as Spark DataFrame jobs."""
