"""Survival prediction from wide measurement tables, as Spark jobs."""
