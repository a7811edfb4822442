"""Tessella: survey analytics, response scoring and corpus preparation as Spark jobs."""
